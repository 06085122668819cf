"""Operations of a large training-data pipeline, as Spark DataFrame operators."""
