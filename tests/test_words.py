"""Visible words of pages whose character references lack their semicolon."""

import hashlib

from pyspark.sql import functions as F

from quillon.functions import textx
from quillon.plans import catalog


def test_open_references(spark, tmp_path):
    pages = {1: "<h1>one&amp;&amp</h1><p>two &copy; &am", 2: "<p>&lt;three&gt &#65;&#66; &unknown; &ampx;</p>", 3: None, 4: "<p>plain"}
    frame = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    out = {r["page_id"]: (r["n"], r["words"]) for r in catalog.load().queries["l08_visible_words"](spark, str(tmp_path)).collect()}
    digest = lambda *w: (len(w), hashlib.md5(" ".join(w).encode()).hexdigest())
    assert out[1] == digest("one", "amp", "two", "am")
    assert out[2] == digest("three", "gt", "AB", "unknown", "ampx")
    assert out[4] == digest("plain")
    # a browser's reading
    read = {r["page_id"]: r["w"] for r in frame.select("page_id", textx.visible_words(F.col("html")).alias("w")).collect()}
    assert read[1] == ["one", "two", "am"]
