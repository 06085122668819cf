"""quillon: a Spark-first engine for tabular conversion, lookup, window, metric and text analytics."""
