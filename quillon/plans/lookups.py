"""Lookups, nearest matches, reconciliation, semi and anti joins, interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import intervals, lookup, reconcile
from ..session import table
from .registry import Registry

registry = Registry()
add = registry.add

add(
    "c01_exact_lookup",
    lambda s, d: lookup.exact(table(s, d, "customer").select("c_custkey", "c_nationkey"), table(s, d, "supplier").withColumnRenamed("s_nationkey", "nk"), "c_nationkey", "nk", "s_name", "s_suppkey", "first_supplier"),
    """WITH s AS (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS first_supplier FROM supplier GROUP BY s_nationkey)
       SELECT c_custkey, c_nationkey, first_supplier FROM customer LEFT JOIN s ON c_nationkey = s_nationkey""",
)

add(
    "c02_not_found_default",
    lambda s, d: lookup.exact(table(s, d, "part").select("p_partkey", "p_size"), table(s, d, "nation"), "p_size", "n_nationkey", "n_name", "n_nationkey", "name", default="none"),
    "SELECT p_partkey, p_size, coalesce(n_name, 'none') AS name FROM part LEFT JOIN nation ON p_size = n_nationkey",
)


def _asof(larger):
    def run(s, d):
        e = table(s, d, "events")
        buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
        views = e.where("event_type = 'view'").select("user_id", "ts", "event_id").withColumnRenamed("event_id", "view_id")
        return lookup.nearest(buys, views, "ts", "ts", "view_id", "view_id", by=["user_id"], larger=larger)

    return run


_ASOF = """WITH b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
  v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
  SELECT b.event_id, b.user_id, b.ts, v.view_id FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts {} v.ts"""
add("c03_asof_smaller", _asof(False), _ASOF.format(">="))
add("c04_asof_larger", _asof(True), _ASOF.format("<="))


def _wild(s, d):
    patterns = s.createDataFrame([(1, "(?i)^.*a.*b.*$", "a*b"), (2, "(?i)^.{1,4}$", "short"), (3, "(?i)^.*$", "any")], "o int, p string, label string")
    return lookup.wildcard(table(s, d, "part").select("p_partkey", "p_name"), patterns, "p_name", "p", "o", "label", "label")


add("c05_wildcard_lookup", _wild, "SELECT p_partkey, p_name, CASE WHEN p_name ILIKE '%a%b%' THEN 'a*b' WHEN length(p_name) BETWEEN 1 AND 4 THEN 'short' ELSE 'any' END AS label FROM part")

add(
    "c06_last_match",
    lambda s, d: lookup.exact(table(s, d, "customer").select("c_custkey"), table(s, d, "orders"), "c_custkey", "o_custkey", "o_orderstatus", "o_orderkey", "last_status", last=True),
    """WITH o AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey)
       SELECT c_custkey, last_status FROM customer LEFT JOIN o ON c_custkey = o_custkey""",
)

add(
    "c07_position",
    lambda s, d: lookup.position(table(s, d, "nation"), "n_regionkey", "n_nationkey"),
    """WITH x AS (SELECT n_regionkey, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation) SELECT n_regionkey, min(p) AS position FROM x GROUP BY n_regionkey""",
)


def _sides(s, d):
    o = table(s, d, "orders")
    listed = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("status"), "o_totalprice")
    stored = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return listed, stored


add(
    "c08_reconcile",
    lambda s, d: reconcile.reconcile(*_sides(s, d), "id", ["status", "o_totalprice"]),
    """WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0),
       s AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 11 <> 0)
       SELECT id, CASE WHEN l.status IS NULL THEN 'missing' WHEN s.status IS NULL THEN 'new' WHEN l.status = s.status THEN 'same' ELSE 'correct' END AS action
       FROM l FULL JOIN s USING (id)""",
)

add(
    "c09_missing_guard",
    lambda s, d: reconcile.missing_guard(*_sides(s, d), "id"),
    """WITH s AS (SELECT count(*) AS stored FROM orders WHERE o_orderkey % 11 <> 0), l AS (SELECT count(*) AS listed FROM orders WHERE o_orderkey % 7 <> 0),
       m AS (SELECT count(*) AS missing FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0)
       SELECT stored, listed, missing, missing > 0 AND (listed = 0 OR (stored >= 4 AND missing > stored * 0.5)) AS refused FROM s, l, m""",
)


def _gate(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    base = l.where("l_linestatus = 'F'").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"))
    now = l.where("l_linestatus = 'O' AND l_suppkey % 9 <> 0").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"))
    return reconcile.gate(now, base, "l_suppkey", "q", True, 0.5, 0.02)


add(
    "c10_baseline_gate",
    _gate,
    """WITH b AS (SELECT l_suppkey, avg(l_quantity) AS base FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
       c AS (SELECT l_suppkey, avg(l_quantity) AS current FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey % 9 <> 0 GROUP BY ALL),
       x AS (SELECT l_suppkey, base, current, greatest(0.5, 0.02 * abs(base)) AS allowed, base - current AS worse_by FROM b FULL JOIN c USING (l_suppkey))
       SELECT *, CASE WHEN base IS NULL THEN 'unbaselined' WHEN current IS NULL THEN 'missing' WHEN worse_by > allowed + 1e-9 THEN 'worse'
                 WHEN -worse_by > allowed + 1e-9 THEN 'improved' ELSE 'ok' END AS verdict FROM x""",
)


def _refusals(s, d):
    o = table(s, d, "orders").withColumn("half", F.year("o_orderdate") % 2)
    r = o.groupBy("o_orderpriority", "half").agg((F.count_if(F.col("o_orderstatus") == "P") / F.count("*")).alias("rate"))
    a = r.where("half = 0").select("o_orderpriority", F.col("rate").alias("base"))
    b = r.where("half = 1").select("o_orderpriority", F.col("rate").alias("now"))
    return a.join(b, "o_orderpriority").withColumn("regressed", F.col("now") > F.col("base") + 0.001)


add(
    "c11_refusal_regression",
    _refusals,
    """WITH r AS (SELECT o_orderpriority, year(o_orderdate) % 2 AS half, count(*) FILTER (WHERE o_orderstatus = 'P') * 1.0 / count(*) AS rate FROM orders GROUP BY ALL)
       SELECT a.o_orderpriority, a.rate AS base, b.rate AS now, b.rate > a.rate + 0.001 AS regressed FROM r a JOIN r b USING (o_orderpriority) WHERE a.half = 0 AND b.half = 1""",
)


def _known(s, d):
    patterns = s.createDataFrame([(1, "^e.*r$", "error"), (2, "^(view|click)$", "read"), (3, "^p", "buy")], "o int, p string, label string")
    types = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return lookup.wildcard(types, patterns, "event_type", "p", "o", "label", "known")


add(
    "c12_pattern_join",
    _known,
    """SELECT event_type, count(*) AS n, CASE WHEN event_type LIKE 'e%r' THEN 'error' WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type LIKE 'p%' THEN 'buy' END AS known
       FROM events GROUP BY event_type""",
)

add(
    "c13_index_resolution",
    lambda s, d: table(s, d, "labels").join(table(s, d, "documents").select("doc_id"), "doc_id", "left_semi").groupBy("quality").agg(F.count("*").alias("n"))
    .unionByName(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").agg(F.lit(-1).alias("quality"), F.count("*").alias("n"))),
    """SELECT quality, count(*) AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY quality
       UNION ALL SELECT -1, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)

add(
    "c17_alias_resolution",
    lambda s, d: table(s, d, "part").select("p_partkey", rules.resolve_alias(F.element_at(F.array(*[F.lit(x) for x in ("JPEG", "png", "yml", "htm", "tiff", "csv")]), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("format")),
    "SELECT p_partkey, ['jpg', 'png', 'yaml', 'html', 'tif', 'csv'][p_partkey % 6 + 1] AS format FROM part",
)


def _intervals(s, d):
    # boxes on an axis, bucketed so that only boxes of touching buckets meet
    x = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 10).alias("x0"), (F.col("p_retailprice") * 10 + F.col("p_size")).alias("x1"))
    return intervals.overlaps(x, "id", "x0", "x1", 64)


add(
    "c18_interval_join",
    _intervals,
    """WITH x AS (SELECT p_partkey AS id, p_retailprice * 10 AS x0, p_retailprice * 10 + p_size AS x1 FROM part)
       SELECT a.id, count(*) AS overlaps, max(b.id) AS last FROM x a JOIN x b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.id < b.id GROUP BY a.id""",
)
