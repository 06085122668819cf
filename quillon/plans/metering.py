"""Metering over events: quota windows, sliding and session windows, service levels, leases, retention, deduplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import datesx, rules
from ..operators import measures, ranking
from ..session import table
from .registry import Registry

registry = Registry()
add = registry.add


def _events(s, d):
    return table(s, d, "events")


add(
    "d22_labelled_counter",
    lambda s, d: _events(s, d).groupBy("event_type", measures.outcome(F.lit(200) + (F.col("event_id") * 7 % 400)).alias("outcome")).agg(F.count("*").alias("n")),
    """SELECT event_type, CASE WHEN 200 + event_id * 7 % 400 < 400 THEN 'ok' WHEN 200 + event_id * 7 % 400 = 504 THEN 'timed_out' WHEN 200 + event_id * 7 % 400 < 500 THEN 'refused' ELSE 'failed' END AS outcome,
       count(*) AS n FROM events GROUP BY ALL""",
)
EDGES = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0]
_SQL_EDGES = "(SELECT unnest([1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 'inf'::DOUBLE]::DOUBLE[]) AS le)"
add(
    "d23_histogram",
    lambda s, d: measures.histogram(_events(s, d), ["event_type"], "value", EDGES),
    f"SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, {_SQL_EDGES} GROUP BY ALL",
)
add(
    "i07_histogram_quantile",
    lambda s, d: measures.histogram_quantile(measures.histogram(_events(s, d), ["event_type"], "value", EDGES), ["event_type"], 0.5).withColumn("quantile", F.round("quantile", 9)),
    f"""WITH h AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, {_SQL_EDGES} GROUP BY ALL),
        w AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS low, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY le), 0) AS before, max(n) OVER (PARTITION BY event_type) * 0.5 AS r FROM h)
        SELECT event_type, round(CASE WHEN le = 'inf' THEN low ELSE low + (le - low) * (r - before) / (n - before) END, 9) AS quantile FROM w
        WHERE n >= r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1""",
)
add(
    "d24_oldest_age",
    lambda s, d: _events(s, d).groupBy("event_type").agg(F.coalesce(F.max(F.lit(1706659200) - F.unix_seconds("ts")), F.lit(0)).alias("oldest_age"), F.coalesce(F.max(F.when(F.col("value") < -1, 1)), F.lit(0)).alias("none")),
    "SELECT event_type, max(1706659200 - epoch_us(ts) // 1000000) AS oldest_age, 0 AS none FROM events GROUP BY event_type",
)
add(
    "d25_queue_states",
    lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["O", "F", "P"]).count().na.fill(0),
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
)


def _charges(s, d):
    ops = F.array(*[F.lit(x) for x in ("convert", "optimize", "merge", "ocr", "import.url", "export.s3")])
    l = table(s, d, "lineitem").withColumn("op", F.element_at(ops, (F.col("l_partkey") % 6 + 1).cast("int")))  # noqa: E741
    out = (F.col("l_linenumber") - 1).cast("long")
    charge = rules.node_charge(F.col("op"), out, F.floor(out / 2), out * 2, F.col("l_quantity") * 10_000)
    return l.groupBy("l_orderkey").agg(F.sum(charge).alias("credits"), F.sum(F.when(F.col("op").startswith("import") | F.col("op").startswith("export"), 0).otherwise(1)).alias("reserved"))


add(
    "d27_graph_charge",
    _charges,
    """WITH l AS (SELECT l_orderkey, ['convert', 'optimize', 'merge', 'ocr', 'import.url', 'export.s3'][l_partkey % 6 + 1] AS op, l_linenumber - 1 AS o, l_quantity * 10000 AS ms FROM lineitem)
       SELECT l_orderkey, sum(CASE op WHEN 'convert' THEN CASE WHEN o > 0 THEN o * 2 + greatest(0, ceil(ms / 60000) - 1)::BIGINT ELSE 0 END WHEN 'optimize' THEN o // 2
              WHEN 'merge' THEN (o > 0)::INT WHEN 'ocr' THEN o ELSE 0 END)::BIGINT AS credits, sum(CASE WHEN op IN ('import.url', 'export.s3') THEN 0 ELSE 1 END)::BIGINT AS reserved FROM l GROUP BY l_orderkey""",
)
add(
    "d28_reservations",
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.greatest(F.lit(1), F.col("l_linenumber"))).alias("units")),
    "SELECT l_orderkey, sum(greatest(1, l_linenumber))::BIGINT AS units FROM lineitem GROUP BY l_orderkey",
)
add(
    "i02_day_window",
    lambda s, d: _events(s, d).groupBy("user_id", datesx.day_key(F.col("ts")).alias("key")).agg(F.count("*").alias("used"), F.expr("date_add(to_date(min(ts)), 1)").alias("ends")),
    "SELECT user_id, strftime(ts, '%Y-%m-%d') AS key, count(*) AS used, min(ts)::DATE + 1 AS ends FROM events GROUP BY ALL",
)
add(
    "i03_month_window",
    lambda s, d: table(s, d, "orders").groupBy("o_custkey", datesx.month_key(F.col("o_orderdate")).alias("key")).agg(F.count("*").alias("used"), F.min(datesx.month_end(F.col("o_orderdate"))).alias("ends")),
    "SELECT o_custkey, 'm' || strftime(o_orderdate, '%Y-%m') AS key, count(*) AS used, (date_trunc('month', min(o_orderdate)) + INTERVAL 1 MONTH)::DATE AS ends FROM orders GROUP BY ALL",
)


def _billing(s, d):
    now = F.lit("1995-02-28 12:00:00").cast("timestamp")
    return table(s, d, "orders").select("o_orderkey", datesx.billing_end(F.col("o_orderdate"), now).alias("ends"))


add(
    "i04_billing_month",
    _billing,
    """WITH o AS (SELECT o_orderkey, o_orderdate AS a, TIMESTAMP '1995-02-28 12:00:00' AS now FROM orders),
       k AS (SELECT *, (year(now) - year(a)) * 12 + month(now) - month(a) AS m FROM o)
       SELECT o_orderkey, CASE WHEN abs(m) > 36 THEN NULL ELSE (SELECT min(e) FROM (VALUES (a + to_months((m - 1)::INT)), (a + to_months(m::INT)), (a + to_months((m + 1)::INT))) v(e) WHERE e > now) END AS ends FROM k""",
)


def _burn(s, d):
    e = _events(s, d).withColumn("bad", (F.col("event_type") == "error").cast("int"))
    w = e.groupBy(F.window("ts", "6 hours", "1 hour").alias("w")).agg(F.sum("bad").alias("bad"), F.count("*").alias("total"))
    return w.where("total >= 20").select(F.col("w.start").alias("start"), "bad", "total", F.round(measures.burn_rate(F.col("bad"), F.col("total"), 0.995), 6).alias("burn"))


add(
    "i05_sliding_burn_rate",
    _burn,
    """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, (event_type = 'error')::INT AS bad FROM events),
       x AS (SELECT h - to_hours(k::INT) AS start, bad FROM e, range(6) r(k))
       SELECT start, sum(bad)::BIGINT AS bad, count(*) AS total, round(sum(bad) / count(*) / 0.005, 6) AS burn FROM x GROUP BY start HAVING count(*) >= 20""",
)


def _rolling(s, d):
    # 28 days up to each day: a frame over the daily sums, not over the events
    daily = _events(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count("*").alias("n"))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-27, 0)
    return daily.select("day", (F.sum("ok").over(w) / F.sum("n").over(w)).alias("availability"))


add(
    "i05_rolling_availability",
    _rolling,
    """WITH d AS (SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) AS n FROM events GROUP BY 1)
       SELECT day, sum(ok) OVER w / sum(n) OVER w AS availability FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW)""",
)
add(
    "i06_latency_share",
    lambda s, d: _events(s, d).groupBy("event_type").agg((F.count_if(F.col("value") <= 10) / F.count("*")).alias("share"), (F.count_if(F.col("value") <= 10) >= 0.95 * F.count("*")).alias("met")),
    "SELECT event_type, count(*) FILTER (WHERE value <= 10) / count(*) AS share, count(*) FILTER (WHERE value <= 10) >= 0.95 * count(*) AS met FROM events GROUP BY event_type",
)


def _leases(s, d):
    # a lease lives for six hours; how many live when each one is asked for, by a range frame per user
    e = _events(s, d).select("user_id", "event_id", F.unix_micros("ts").alias("t"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-6 * 3_600_000_000 + 1, 0)
    return e.withColumn("live", F.count("*").over(w)).select("event_id", "live", (F.col("live") <= 2).alias("admitted"))


add(
    "i08_leases",
    _leases,
    """WITH x AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS live FROM events)
       SELECT event_id, live, live <= 2 AS admitted FROM x""",
)


def _sweep(s, d):
    e = _events(s, d).select("event_id", F.expr("ts + INTERVAL 5 DAYS").alias("delete_at"), F.when(F.col("event_id") % 4 == 0, F.expr("ts + INTERVAL 9 DAYS")).alias("hold"), F.when(F.col("event_id") % 6 == 0, F.expr("ts + INTERVAL 12 DAYS")).alias("retry"))
    kept = F.greatest("delete_at", "hold")
    at = F.greatest(kept, "retry")
    now = F.lit("2024-01-20").cast("timestamp")
    return e.select("event_id", at.alias("sweep_at")).where(at <= now)


add(
    "i10_retention_sweep",
    _sweep,
    """WITH e AS (SELECT event_id, greatest(ts + INTERVAL 5 DAY, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 9 DAY END, CASE WHEN event_id % 6 = 0 THEN ts + INTERVAL 12 DAY END) AS sweep_at FROM events)
       SELECT event_id, sweep_at FROM e WHERE sweep_at <= TIMESTAMP '2024-01-20'""",
)


def _idempotent(s, d):
    e = _events(s, d).withColumn("key", F.concat_ws("-", "user_id", F.to_date("ts")))
    first = F.first("event_id").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    same = F.first("event_type").over(Window.partitionBy("key").orderBy("ts", "event_id")) == F.col("event_type")
    return e.select("event_id", F.when(first == F.col("event_id"), "acquired").when(same, "replayed").otherwise("mismatched").alias("answer"))


add(
    "i11_idempotent_acquire",
    _idempotent,
    """WITH e AS (SELECT event_id, event_type, first_value(event_id) OVER w AS f, first_value(event_type) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id))
       SELECT event_id, CASE WHEN f = event_id THEN 'acquired' WHEN t = event_type THEN 'replayed' ELSE 'mismatched' END AS answer FROM e""",
)
add(
    "i12_latest_wins",
    lambda s, d: _events(s, d).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("m")).select("user_id", "m.*"),
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
add(
    "i15_dead_letters",
    lambda s, d: ranking.placed(_events(s, d).where((F.col("event_type") == "error") & (F.col("ts") > F.lit("2024-01-10").cast("timestamp"))).select("event_id", "ts"), [F.asc("ts"), F.asc("event_id")], "place").drop("ts"),
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-10'",
)


def _sessions(s, d):
    e = _events(s, d).groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


add(
    "i17_session_window",
    _sessions,
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)


def _bucket(s, d):
    from ..streaming.state import token_bucket

    return token_bucket(_events(s, d).select("user_id", "event_id", F.unix_micros("ts").alias("t")), "user_id", "event_id", "t", capacity=3.0, per_second=3.0 / 86400)


add(
    "i19_token_bucket",
    _bucket,
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
       r(user_id, event_id, t, i, had) AS (
         SELECT user_id, event_id, t, i, 3.0::DOUBLE FROM e WHERE i = 1
         UNION ALL
         SELECT e.user_id, e.event_id, e.t, e.i, least(3.0::DOUBLE, r.had - (r.had >= 1)::INT + (e.t - r.t) / 1e6::DOUBLE * (3.0::DOUBLE / 86400)) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
       SELECT event_id, had >= 1 AS admitted FROM r""",
)
add(
    "i20_presence",
    lambda s, d: _events(s, d).groupBy("user_id").agg(F.max("ts").alias("beat")).withColumn("live", F.col("beat") > F.lit("2024-01-29").cast("timestamp")),
    "SELECT user_id, max(ts) AS beat, max(ts) > TIMESTAMP '2024-01-29' AS live FROM events GROUP BY user_id",
)
