import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} and the {i}" for i in range(30_000))


def prose(rng, n):
    return " ".join(rng.choice("the of and quick brown fox jumps over lazy dog every morning while rain falls softly upon green hills".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(30, 120)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [
        (100, None, None, None, None), (101, "", "en", "s1", 0), (102, "   \n\t ", "en", None, 6), (103, "1234 5678", "en", "s1", 9),
        (104, LONG, "en", "s2", len(LONG)), (105, base[0], "en", "s0", 1), (106, base[0], "fr", None, 1), (None, base[3], "en", "s1", 1),
        (107, base[2] + " tail end", "en", "s2", 1), (108, "é̀ ünïcode ☃ text\r\nwith lines\nwith lines\n", "de", "s3", 30),
        (109, "one two", None, "s3", 7), (109, "one two", None, "s3", 7), (110, "ONE two", "en", "s3", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("size", "shard", "kept", "n", "id", "cls", "words", "key")})


@pytest.fixture
def tables(spark, tmp_path):
    """Writes rows as a table of a folder and gives the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture
def odd_dir(odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.fixture
def empty_dir(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)
