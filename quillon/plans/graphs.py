"""Job graphs: edges, levels, reachability, failure policies, the catalogue of operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import dag
from ..session import table
from .registry import Registry

registry = Registry()
add = registry.add


def _graph(s, d):
    """Nodes are suppliers; each takes the outputs of a half and a third of its number."""
    n = table(s, d, "supplier").select(F.col("s_suppkey").alias("node"))
    e = n.select(F.explode(F.array(F.floor(F.col("node") / 2), F.floor(F.col("node") / 3))).alias("src"), F.col("node").alias("dst"))
    return n, e.where("src > 0").distinct()


_SQL = """n AS (SELECT s_suppkey AS node FROM supplier),
  e AS (SELECT DISTINCT src, node AS dst FROM (SELECT node, unnest([node // 2, node // 3]) AS src FROM n) WHERE src > 0)"""

add(
    "c14_edges",
    lambda s, d: (lambda n, e: n.join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inputs")), "node", "left").join(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("children")), "node", "left").na.fill(0))(*_graph(s, d)),
    f"WITH {_SQL} SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS inputs, (SELECT count(*) FROM e WHERE src = node) AS children FROM n",
)
add(
    "i13_ready_levels",
    lambda s, d: (lambda n, e: dag.levels(s, n, e))(*_graph(s, d)),
    f"""WITH RECURSIVE {_SQL}, r(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node)
        SELECT node, max(level) AS level FROM r GROUP BY node""",
)


def _cells(s, d):
    # a sheet's cells: node 4 and 9 refer to each other, so they and all behind them have no level
    n, e = _graph(s, d)
    loop = s.createDataFrame([(9, 4)], "src long, dst long")
    return dag.levels(s, n, e.unionByName(loop)).select("node", F.col("level").isNull().alias("cycle"))


add(
    "c15_cell_cycles",
    _cells,
    f"""WITH RECURSIVE {_SQL}, r(node) AS (SELECT 4 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
        SELECT node, node IN (SELECT node FROM r) AS cycle FROM n""",
)


def _failure(policy):
    def run(s, d):
        n, e = _graph(s, d)
        return dag.apply_failure(s, n, e, s.createDataFrame([(5,)], "node long"), policy)

    return run


add(
    "i14_failure_continue",
    _failure("continue"),
    f"""WITH RECURSIVE {_SQL}, r(node) AS (SELECT 5 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
        SELECT node, CASE WHEN node = 5 THEN 'failed' WHEN node IN (SELECT node FROM r) THEN 'skipped' ELSE 'ready' END AS state FROM n""",
)
add("i14_failure_fail_fast", _failure("fail_fast"), "SELECT s_suppkey AS node, CASE WHEN s_suppkey = 5 THEN 'failed' ELSE 'cancelled' END AS state FROM supplier")


def _operations(s, d):
    ops = s.createDataFrame([(o,) for o in rules.OPERATIONS], "op string")
    one = rules.node_charge(F.col("op"), F.lit(3), F.lit(2), F.lit(6), F.lit(130_000))
    return ops.select("op", F.substring_index("op", ".", 1).alias("kind"), one.alias("credits"))


add(
    "k_operations",
    _operations,
    f"""SELECT op, string_split(op, '.')[1] AS kind, (CASE WHEN op = 'convert' THEN 8 WHEN op = 'optimize' THEN 2
         WHEN op IN ('merge', 'metadata', 'capture.website', 'archive.create', 'archive.extract') THEN 1 WHEN op LIKE 'import.%' OR op LIKE 'export.%' THEN 0 ELSE 3 END)::BIGINT AS credits
       FROM (SELECT unnest({rules.OPERATIONS!r}) AS op)""",
)
add(
    "k_catalogue",
    lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_set("n_name")).alias("targets")).select("n_regionkey", F.explode("targets").alias("target")),
    "SELECT DISTINCT n_regionkey, n_name AS target FROM nation",
)
