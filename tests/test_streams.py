"""Streams that append rows: the rows go to files, not to the driver, and all of them come back."""

from pyspark.sql import functions as F

from quillon.session import scratch
from quillon.sources import delimited
from quillon.streaming import state


def test_appended_rows_are_files(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    folder = scratch(spark, "stream")
    out = state.run_once(state.first_only(stream, ["k"], "1 day"), "appended", folder, "append")
    assert out.inputFiles()
    assert sorted(r["k"] for r in out.collect()) == list(range(1000))
    assert spark.conf.get(store) == before
    # a second run over the same folder finds nothing new and repeats nothing
    assert state.run_once(state.first_only(stream, ["k"], "1 day"), "appended", folder, "append").count() == 1000


def test_delimited_stream_is_files(spark):
    from quillon.plans import catalog

    out = catalog.load().queries["i01_stream_delimited"](spark, "/root/testdata/sf0.001")
    assert out.inputFiles()
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_delimited_stream_keeps_breaks_in_cells(spark, tmp_path):
    from quillon.plans import catalog

    odd = ["O", "a\nb", "a\rb", "a\tb", 'say "q"', " x ", "é"]
    spark.createDataFrame(list(enumerate(odd)), "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    out = catalog.load().queries["i01_stream_delimited"](spark, str(tmp_path))
    assert sorted(r["value"] for r in out.collect()) == sorted(f"{k},{s}" for k, s in enumerate(odd))


def test_plain_cells_are_not_searched_again_and_again(spark):
    df = spark.range(5).select((F.col("id") - 2).alias("k"), F.col("id").cast("string").alias("t"))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    whole = delimited.format_lines(df.select("k", F.col("k").alias("n")), "\t")
    assert "RLIKE" not in plan(whole)
    assert sorted(r["value"] for r in whole.collect()) == sorted(f"{k}\t{k}" for k in range(-2, 3))
    # a number is turned into text once, though patterns look at it several times
    assert plan(delimited.format_lines(df.select(F.col("k").cast("double")), "\t")).lower().count("as string)") == 1
    # the array functions, which run row by row outside generated code, are left to records with quotes
    cut = plan(df.select(delimited.parse_cells(F.col("t"), "\t").alias("c")))
    assert "split(" in cut[: cut.index("transform(")]
    assert "Contains" in cut[: cut.index("transform(")] or "contains(" in cut[: cut.index("transform(")].lower()
