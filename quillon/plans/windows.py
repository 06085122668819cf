"""Ranks, running allocation, caps, intervals, segments, rates; sorts, top-k, pagination; set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.textx import natural_key, slug
from ..operators import intervals, lookup, measures, ranking, series
from ..session import table
from .registry import Registry

registry = Registry()
add = registry.add

add(
    "e01_rank",
    lambda s, d: table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"))).alias("rank_desc"),
        F.rank().over(Window.partitionBy("l_orderkey").orderBy("l_quantity")).alias("rank_asc"),
    ),
    """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS rank_desc,
       rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS rank_asc FROM lineitem""",
)
add(
    "e02_rank_avg",
    lambda s, d: table(s, d, "events").select("event_id", ranking.rank_avg("event_type", ["user_id"]).alias("r")),
    """SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY event_type DESC) + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2 AS r FROM events""",
)
add(
    "e03_percent_rank",
    lambda s, d: table(s, d, "customer").select(
        "c_custkey",
        (F.floor(F.percent_rank().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal")) * 1000) / 1000).alias("inc"),
        ranking.percent_rank_exc("c_acctbal", ["c_nationkey"]).alias("exc"),
    ),
    """SELECT c_custkey, floor(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) * 1000) / 1000 AS inc,
       rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) / (count(*) OVER (PARTITION BY c_nationkey) + 1) AS exc FROM customer""",
)


def _burn(s, d):
    g = table(s, d, "orders").select("o_custkey", F.lit(1).alias("one"), (F.col("o_orderkey") % 3).alias("priority"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("expires"), "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("remaining"))
    g = g.withColumn("name", F.col("o_orderkey").cast("string"))
    out = ranking.allocate(g, ["o_custkey"], ranking.burn_order("priority", "expires", "o_orderkey", "name"), "remaining", F.lit(400), "spent")
    return out.select("o_orderkey", "remaining", "spent")


add(
    "e04_burn_down",
    _burn,
    """WITH g AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS p, CASE WHEN o_orderkey % 4 <> 0 THEN (epoch_us(o_orderdate) // 1000000) END AS x, floor(o_totalprice / 1000)::BIGINT AS remaining FROM orders),
       b AS (SELECT *, coalesce(sum(remaining) OVER (PARTITION BY o_custkey ORDER BY p, x NULLS LAST, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
       SELECT o_orderkey, remaining, greatest(0, least(remaining, 400 - before))::BIGINT AS spent FROM b""",
)
add(
    "e05_cap_per_user",
    lambda s, d: ranking.keep_newest(table(s, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5),
    "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5",
)
add(
    "e06_dedupe_numbering",
    lambda s, d: ranking.dedupe_names(table(s, d, "customer").select(slug(F.col("c_mktsegment")).alias("name"), "c_custkey"), "name", "c_custkey", "-"),
    """WITH x AS (SELECT lower(replace(trim(c_mktsegment), ' ', '-')) AS name, c_custkey FROM customer),
       r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) - 1 AS r FROM x)
       SELECT name, c_custkey, CASE WHEN r = 0 THEN name ELSE name || '-' || r END AS unique_name FROM r""",
)


def _lookahead(s, d):
    c = table(s, d, "conversations").withColumn("said", F.when(F.col("role") == "assistant", F.col("turn")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), F.first("said", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next_answer"))


add(
    "e07_lookahead",
    _lookahead,
    """SELECT conv_id, turn, lead(turn) OVER w AS next_turn,
       min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_answer
       FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)


def _ratios(s, d):
    return table(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 100000 + 0.5).alias("ratio"))


add(
    "e08_prediction_bound",
    lambda s, d: series.lower_bound(_ratios(s, d), ["o_custkey"], "o_orderkey", "ratio").select("o_orderkey", "points", F.round("centre", 9).alias("centre"), F.round("lower", 9).alias("lower")),
    f"""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice / 100000 + 0.5 AS ratio FROM orders),
        h AS (SELECT o_orderkey, count(*) OVER w AS n, avg(ln(ratio)) OVER w AS c, stddev_samp(ln(ratio)) OVER w AS sd FROM r
              WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
        SELECT o_orderkey, n AS points, round(exp(c), 9) AS centre, CASE WHEN n >= 5 THEN round(exp(c - {series.T99!r}[n - 1] * sd * sqrt(1 + 1 / n)), 9) END AS lower FROM h""",
)
add(
    "e09_step_restart",
    lambda s, d: series.since_last_step(_ratios(s, d), "o_custkey", "o_orderkey", "ratio"),
    f"""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice / 100000 + 0.5 AS ratio, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
        r(o_custkey, i, keys, logs) AS (
          SELECT o_custkey, 1::BIGINT, [o_orderkey], [ln(ratio)] FROM o WHERE i = 1
          UNION ALL
          SELECT o_custkey, n, CASE WHEN up THEN [k] ELSE list_append(keys, k)[-10:] END, CASE WHEN up THEN [x] ELSE list_append(logs, x)[-10:] END
          FROM (SELECT r.o_custkey, o.i AS n, o.o_orderkey AS k, ln(o.ratio) AS x, keys, logs,
                       ln(o.ratio) > list_avg(logs) + ln(1.6) OR (len(logs) >= 5 AND ln(o.ratio) > list_avg(logs) + {series.T99!r}[len(logs) - 1] * greatest(list_stddev_samp(logs), 0.05) * sqrt(1 + 1 / len(logs))) AS up
                FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1)),
        l AS (SELECT o_custkey, unnest(keys) AS o_orderkey FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY i DESC) = 1)
        SELECT o_custkey, o_orderkey, ratio FROM l JOIN o USING (o_custkey, o_orderkey)""",
)
add(
    "e10_history_floor",
    lambda s, d: series.history_floor(_ratios(s, d), ["o_custkey"], "o_orderkey", "ratio").select("o_orderkey", "floor"),
    """SELECT o_orderkey, 0.65 * median(o_totalprice / 100000 + 0.5) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS floor FROM orders""",
)


def _spans(s, d):
    return table(s, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 1000 * 10).alias("a"), (F.col("l_orderkey") % 1000 * 10 + F.rint("l_quantity").cast("long")).alias("b"))


_SQL_ISLANDS = """WITH x AS (SELECT l_suppkey, l_orderkey % 1000 * 10 AS a, l_orderkey % 1000 * 10 + l_quantity::BIGINT AS b FROM lineitem),
  m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x),
  i AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m),
  r AS (SELECT l_suppkey, min(a) AS a, max(b) AS b, count(*) AS parts FROM i GROUP BY l_suppkey, g)"""
add("e11_islands", lambda s, d: intervals.merge(_spans(s, d), ["l_suppkey"], "a", "b"), _SQL_ISLANDS + " SELECT * FROM r")
add(
    "i09_coverage",
    lambda s, d: intervals.covers(intervals.merge(_spans(s, d), ["l_suppkey"], "a", "b"), ["l_suppkey"], "a", "b", F.lit(10000)),
    _SQL_ISLANDS + " SELECT l_suppkey, count(*) = 1 AND min(a) = 0 AND max(b) >= 9999 AS covered FROM r GROUP BY l_suppkey",
)
add(
    "e12_counter_increase",
    lambda s, d: measures.increase(table(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("event_id", F.round("increase", 6).alias("increase")),
    """WITH x AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
       SELECT event_id, round(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END, 6) AS increase FROM x""",
)


def _size_levels(s, d):
    sizes = table(s, d, "part").select("p_brand", "p_size").distinct()
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"))
    opens = F.when(F.lag("p_size").over(w) - F.col("p_size") > 1, 1).otherwise(0)
    return sizes.withColumn("n", opens).select("p_brand", "p_size", F.least(F.sum("n").over(w) + 1, F.lit(6)).alias("level"))


add(
    "e13_tolerance_levels",
    _size_levels,
    """WITH z AS (SELECT DISTINCT p_brand, p_size FROM part), x AS (SELECT *, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size DESC) - p_size > 1 AS o FROM z)
       SELECT p_brand, p_size, least(sum(coalesce(o, false)::INT) OVER (PARTITION BY p_brand ORDER BY p_size DESC) + 1, 6)::BIGINT AS level FROM x""",
)
add(
    "e14_segments",
    lambda s, d: intervals.segments(table(s, d, "events").select("user_id", F.unix_seconds("ts").alias("at")), ["user_id"], "at", 36000),
    """WITH x AS (SELECT user_id, epoch_us(ts) // 1000000 AS at_, lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
       g AS (SELECT user_id, at_, sum(CASE WHEN at_ - p > 36000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_) AS segment FROM x)
       SELECT user_id, segment::BIGINT AS segment, min(at_) AS start, max(at_) AS "end", count(*) AS n FROM g GROUP BY user_id, segment""",
)

# sorts, limits, top-k
add(
    "f01_kth_largest",
    lambda s, d: ranking.kth(table(s, d, "lineitem"), ["l_suppkey"], "l_quantity", 3, "third_largest").join(ranking.kth(table(s, d, "lineitem"), ["l_suppkey"], "l_quantity", 2, "second_smallest", largest=False), "l_suppkey"),
    "SELECT l_suppkey, list_sort(list(l_quantity), 'DESC')[3] AS third_largest, list_sort(list(l_quantity))[2] AS second_smallest FROM lineitem GROUP BY l_suppkey",
)
add(
    "f02_newest_first",
    lambda s, d: table(s, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(25).select("o_orderkey", "o_orderdate"),
    "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25",
)


def _page(s, d):
    o = table(s, d, "customer")
    total = o.agg(F.count("*").alias("total"))
    page = o.orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey", "c_acctbal")
    return page.join(F.broadcast(total), how="cross")  # one row


add("f03_pagination", _page, "SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")


def _multi(s, d):
    e = table(s, d, "events").withColumn("expires", F.when(F.col("event_id") % 3 != 0, F.col("ts")))
    return ranking.placed(e.select("event_id", "event_type", "expires"), [F.asc("event_type"), F.asc_nulls_last("expires"), F.asc("event_id")], "place")


add(
    "f04_multi_key_sort",
    _multi,
    "WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 <> 0 THEN ts END AS expires FROM events) SELECT *, row_number() OVER (ORDER BY event_type, expires NULLS LAST, event_id) AS place FROM e",
)
add(
    "f05_eviction_order",
    lambda s, d: ranking.placed(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).asc(), F.asc("o_orderdate"), F.asc("o_orderkey")], "place").drop("o_orderdate"),
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS place FROM orders",
)
add(
    "f06_due_first",
    lambda s, d: table(s, d, "orders").where(F.col("o_orderdate") <= F.lit("1996-01-01").cast("timestamp")).orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50",
)


def _mixed(s, d):
    e = table(s, d, "events").withColumn("cell", F.when(F.col("event_id") % 3 == 0, F.col("value").cast("int").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise((F.col("value") > 50).cast("string")))
    rank = F.col("event_id") % 3
    w = Window.partitionBy("user_id").orderBy(rank, F.when(rank == 0, F.col("value").cast("int")), F.upper("cell"), "event_id")
    return e.select("event_id", F.row_number().over(w).alias("place"))


add(
    "f07_mixed_type_sort",
    _mixed,
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, CASE WHEN event_id % 3 = 0 THEN trunc(value)::INT END NULLS FIRST,
       upper(CASE event_id % 3 WHEN 0 THEN trunc(value)::INT::VARCHAR WHEN 1 THEN event_type ELSE (value > 50)::VARCHAR END), event_id) AS place FROM events""",
)
add(
    "f09_natural_sort",
    lambda s, d: table(s, d, "supplier").select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(natural_key(F.concat(F.lit("p"), "s_suppkey")))).alias("place")),
    "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier",
)

# set operations
add(
    "g01_union_all_shards",
    lambda s, d: table(s, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(0).alias("shard")).unionAll(table(s, d, "orders").where("o_orderkey % 2 = 1").select("o_orderkey", F.lit(1).alias("shard"))).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids")),
    "SELECT (o_orderkey % 2)::INT AS shard, count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders GROUP BY 1",
)
add(
    "g02_union_distinct",
    lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct(),
    "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
)
add(
    "g03_multiset_intersection",
    lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(s, d, "supplier").select("s_nationkey")).groupBy("k").agg(F.count("*").alias("n")),
    """WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
       SELECT k, least(c.n, s.n) AS n FROM c JOIN s USING (k)""",
)
add(
    "g04_difference",
    lambda s, d: table(s, d, "part").select("p_partkey").subtract(table(s, d, "lineitem").where("l_quantity > 47").select("l_partkey")),
    "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 47",
)
add(
    "g05_distinct_first",
    lambda s, d: lookup.first_match(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey"),
    "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
)
add(
    "g06_ordered_merge",
    lambda s, d: table(s, d, "region").select(F.lit(0).alias("part"), F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("cell")).unionAll(table(s, d, "nation").select(F.lit(1), "n_nationkey", "n_name")).orderBy("part", "ordinal"),
    "SELECT 0 AS part, r_regionkey AS ordinal, r_name AS cell FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation",
)
