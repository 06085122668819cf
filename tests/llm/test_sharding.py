import zlib
from collections import defaultdict

from quillon.llm import sharding
from quillon.llm.queries import QUERIES


def _check(rows, out, shards=8, slack=None):
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    size = defaultdict(int)
    for r in out:
        size[r["shard"]] += r["size"]
    if slack is not None:
        assert max(size.values()) - min(size.get(s, 0) for s in range(shards)) <= slack


def test_sizes_digests_and_slots(spark, odd_dir, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    out = QUERIES["op3_sampled_splitters"](spark, odd_dir).collect()
    _check(rows, out)
    want = sorted((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == want


def test_balance_and_groups(spark, tables):
    rows = [(i, f"text {i} " * (1 + i % 9), "en", "s", 1) for i in range(3000)] + [(10_000 + i, "copy " * 5, "en", "s", 1) for i in range(400)]
    d = tables("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = QUERIES["op3_sampled_splitters"](spark, d).collect()
    total = sum(r["size"] for r in out)
    _check(rows, out, slack=total * 0.02 / 8 + 200)
    groups = defaultdict(set)
    for r in out:
        groups[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())


def test_a_group_beyond_a_shard_is_split_evenly(spark, tables):
    rows = [(i, "same text " * 20, "en", "s", 1) for i in range(2000)] + [(9000 + i, f"other {i}" * 9, "en", "s", 1) for i in range(700)]
    d = tables("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = QUERIES["op3_sampled_splitters"](spark, d).collect()
    _check(rows, out, slack=sum(r["size"] for r in out) * 0.1 / 8)
    again = QUERIES["op3_sampled_splitters"](spark, d).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_boundaries_close_hot_keys():
    cut = sharding._boundaries([5] * 50 + list(range(100, 150)), 10)
    assert 5 in cut and 6 in cut


def test_search_counts_bounds(spark):
    from pyspark.sql import functions as F

    bounds = [-5, 0, 3, 9, 10, 11, 40]
    df = spark.createDataFrame([(x,) for x in range(-7, 45)], "x long").withColumn("r", sharding.search(bounds, F.col("x")))
    assert all(r["r"] == sum(b <= r["x"] for b in bounds) for r in df.collect())
