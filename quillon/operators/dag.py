"""Graphs of jobs or cells: levels, reachability, cycles, failure policies. Edges are (src, dst) rows.

A graph of at most SMALL edges, checked, is walked in one pass over arrays; the graph of a job has some hundred. Larger
ones are walked by rounds, each of which goes on from the nodes that the last one found and is staged, until a round finds
nothing: depth is bounded by nothing but the graph's own, and a node is visited once whatever the number of its paths."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

#: Edges that the driver holds, at most.
SMALL = 100_000


def _few(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[list, list] | None:
    """The edges, and the nodes, if both are at most SMALL; else None."""
    found = edges.select("src", "dst").limit(SMALL + 1).collect()
    named = nodes.select("node").limit(SMALL + 1).collect() if nodes is not None else []
    return None if max(len(found), len(named)) > SMALL else ([tuple(r) for r in found], [r[0] for r in named])


def levels(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a node without inputs; null for nodes on or behind a cycle."""
    few = _few(edges, nodes)
    if few is None:
        return _levels_by_rounds(nodes, edges)
    after, needs = defaultdict(list), defaultdict(int)
    for a, b in few[0]:
        after[a].append(b)
        needs[b] += 1
    level = {n: 0 for n in few[1] if not needs[n]}
    now = list(level)
    while now:
        later = []
        for a in now:
            for b in after[a]:
                needs[b] -= 1
                if not needs[b]:
                    level[b] = level[a] + 1
                    later.append(b)
        now = later
    kind = nodes.schema["node"].dataType.simpleString()
    placed = spark.createDataFrame([(n, k) for n, k in level.items()], f"node {kind}, level int")
    return nodes.select("node").join(placed, "node", "left")


def _levels_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A node is placed once all its inputs are: rounds carry how many inputs each node still waits for."""
    waits = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("waits"))
    state = nodes.select("node").join(waits, "node", "left").na.fill(0, ["waits"])
    state = staged(state.withColumn("level", F.when(F.col("waits") == 0, F.lit(0))), "levels")
    level = 0
    while not state.where(F.col("level") == level).isEmpty():
        got = edges.join(state.where(F.col("level") == level).select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("got"))
        left = F.col("waits") - F.coalesce("got", F.lit(0))
        fresh = F.when(F.col("level").isNull() & (left == 0), F.lit(level + 1))
        state = staged(state.join(got, "node", "left").select("node", left.alias("waits"), F.coalesce("level", fresh).alias("level")), "levels")
        level += 1
    return state.select("node", "level")


def reachable(spark: SparkSession, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): all that can be reached from the start nodes, these included."""
    few = _few(edges, start)
    if few is None:
        return _reachable_by_rounds(edges, start)
    after = defaultdict(list)
    for a, b in few[0]:
        after[a].append(b)
    found = set(few[1])
    now = list(found)
    while now:
        now = [b for b in {b for a in now for b in after[a]} if b not in found]
        found |= set(now)
    return spark.createDataFrame([(n,) for n in found], f"node {start.schema['node'].dataType.simpleString()}")


def _reachable_by_rounds(edges: DataFrame, start: DataFrame) -> DataFrame:
    found = staged(start.select("node").distinct(), "reached")
    now = found
    while not now.isEmpty():
        ahead = edges.join(now.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        now = staged(ahead.join(found, "node", "left_anti"), "frontier")
        found = staged(found.unionByName(now), "reached")
    return found


def apply_failure(spark: SparkSession, nodes: DataFrame, edges: DataFrame, failed: DataFrame, policy: str) -> DataFrame:
    """(node, state): with `fail_fast` all unfinished nodes are cancelled, with `continue` only descendants are skipped."""
    down = reachable(spark, edges, failed).withColumn("_down", F.lit(True))
    bad = failed.withColumn("_failed", F.lit(True))
    state = F.when(F.col("_failed"), "failed")
    state = state.otherwise("cancelled") if policy == "fail_fast" else state.when(F.col("_down"), "skipped").otherwise("ready")
    return nodes.select("node").join(down, "node", "left").join(bad, "node", "left").select("node", state.alias("state"))
