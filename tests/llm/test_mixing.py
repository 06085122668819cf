import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing
from quillon.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Water filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        per = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if per * weight[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **{s: per * weight[s] for s in free}}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets():
    rng = random.Random(1)
    for _ in range(50):
        sizes = {f"s{i:02}": rng.choice([0, 1, 50, 10_000]) for i in range(rng.randrange(1, 12))} | {None: 7}
        got = mixing.targets(sizes, mixing.cycle_weights(list(sizes)))
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_splitting_tree_is_exact_and_even():
    counts = np.array([1000, 10, 0, 333])
    for shards in (1, 2, 3, 7, 16):
        out = mixing.split(counts, shards, 1)
        assert (out.sum(axis=0) == counts).all() and (out >= 0).all()
        assert max(out.sum(axis=1)) - min(out.sum(axis=1)) <= np.ceil(np.log2(max(shards, 2))) + 1
        assert (out == mixing.split(counts, shards, 1)).all()


def _rows():
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 60), None, "hot" if i % 3 == 0 else f"s{i % 11}", None) for i in range(1500)]
    return rows + [(9000, None, None, "s1", None), (9001, "", None, None, None), (9002, "a b c", None, None, None), (9003, "z " * 4000, None, "s2", None), (9004, None, None, "wordless", None)]


def test_query_against_the_law(spark, tables):
    rows = _rows()
    d = tables("documents", rows, SCHEMA)
    out = {r["doc_id"]: r for r in QUERIES["op9_hypergeometric_mix"](spark, d).collect()}
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, got = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for i, t, _, s, _ in rows:
        r = out[i]
        assert (r["size"], r["source_size"]) == (size(t), sizes[s]) and r["target"] == pytest.approx(want[s])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        got[s] += r["taken"]
    assert all(abs(got[s] - want[s]) <= max(2, 0.01 * want[s]) for s in sizes if s != "s2")
    again = {r["doc_id"]: r for r in QUERIES["op9_hypergeometric_mix"](spark, d).collect()}
    assert again == out


def test_mix_gives_the_rows_and_keeps_columns(spark, odd_docs):
    dealt = mixing.deal(odd_docs).collect()
    rows = mixing.mix(odd_docs)
    assert rows.columns == [*odd_docs.columns, mixing.P + "shard", mixing.P + "order"]
    assert rows.count() == sum(len(r[mixing.P + "copies"]) for r in dealt)
    assert {r[0] for r in rows.select(mixing.P + "shard").distinct().collect()} <= set(range(mixing.SHARDS))
    assert mixing.shuffled(rows, slices=3).count() == rows.count()
    assert mixing.slices_for(odd_docs) == 1 and mixing.slices_for(odd_docs.limit(0)) == 1


def test_shuffled_interleaves_the_sources_as_drawn(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'w ' * 5}{i}", "abcd"[i * 4 // 8000]) for i in range(8000)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, shards=4)
    parts = mixing.shuffled(mixed, 2, 4).select(F.spark_partition_id().alias("part"), mixing.P + "shard", mixing.P + "order", "source").collect()
    assert sorted(str(tuple(r[1:])) for r in parts) == sorted(str(tuple(r)) for r in mixed.select(mixing.P + "shard", mixing.P + "order", "source").collect())
    groups = {}
    for r in parts:
        groups.setdefault(r["part"], []).append(r)
    assert len(groups) == 8 and max(map(len, groups.values())) < 1.3 * min(map(len, groups.values()))
    for rows in groups.values():
        assert len({r[1] for r in rows}) == 1 and [r[2] for r in rows] == sorted(r[2] for r in rows)
        share = [sum(r["source"] == s for r in rows) / len(rows) for s in "abcd"]
        same = sum(x["source"] == y["source"] for x, y in zip(rows, rows[1:])) / (len(rows) - 1)
        assert same < sum(x * x for x in share) + 0.1 and min(share) > 0
    # in range order over the partitions of a shard
    for a in range(0, 8, 2):
        assert groups[a][-1][2] <= groups[a + 1][0][2]


def test_a_large_last_block_is_cut_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 2)
    monkeypatch.setattr(mixing, "LAST_RECORDS", 64)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 40), None if i % 7 == 0 else "ab"[i % 2]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, want = {}, {}
    for r in mixing.deal(docs).collect():
        got[r["source"]] = got.get(r["source"], 0) + r[mixing.P + "size"] * len(r[mixing.P + "copies"])
        want[r["source"]] = r[mixing.P + "target"]
    assert all(abs(got[s] - want[s]) <= 2 for s in want)


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 5)
    docs = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(9)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="sources"):
        mixing.deal(docs)
