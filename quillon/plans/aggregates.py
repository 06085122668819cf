"""Aggregates: sums, counts, moments, percentiles, regression, conditional and weighted forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions
from ..functions.criteria import all_of, criterion
from ..session import table
from .registry import Registry

registry = Registry()
add = registry.add


def _lines(spark, d):
    return table(spark, d, "lineitem")


def _signed():
    return F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.lit(1)) * (1 + F.col("l_tax") / 1000)


BY = ["l_returnflag", "l_linestatus"]

add(
    "d01_sums",
    lambda s, d: _lines(s, d).groupBy(*BY).agg(
        F.coalesce(F.sum("l_quantity"), F.lit(0)).alias("total"),
        F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("sumsq"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("sumproduct"),
        F.coalesce(F.sum(F.when(F.col("l_quantity") < 0, F.col("l_quantity"))), F.lit(0)).alias("empty_sum"),
        F.round(F.product(F.when(F.col("l_linenumber") <= 2, _signed())), 6).alias("product"),
        F.product(F.when(F.col("l_linenumber") <= 2, F.col("l_tax"))).alias("product_zero"),
    ),
    """SELECT l_returnflag, l_linestatus, coalesce(sum(l_quantity), 0) AS total, sum(l_quantity * l_quantity) AS sumsq,
       round(sum(l_extendedprice * l_discount), 2) AS sumproduct, coalesce(sum(l_quantity) FILTER (WHERE l_quantity < 0), 0) AS empty_sum,
       round(product(CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END * (1 + l_tax / 1000)) FILTER (WHERE l_linenumber <= 2), 6) AS product,
       product(l_tax) FILTER (WHERE l_linenumber <= 2) AS product_zero
       FROM lineitem GROUP BY ALL""",
)

add(
    "d02_counts",
    lambda s, d: table(s, d, "orders").select("o_orderstatus", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("n"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("t"))
    .groupBy("o_orderstatus")
    .agg(F.count("n").alias("count_numbers"), F.count("t").alias("counta"), F.count_if(F.col("t").isNull()).alias("countblank")),
    """SELECT o_orderstatus, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS count_numbers,
       count(nullif(o_orderpriority, '5-LOW')) AS counta, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS countblank
       FROM orders GROUP BY o_orderstatus""",
)

add(
    "d03_averages",
    lambda s, d: table(s, d, "customer").groupBy("c_nationkey").agg(
        F.avg("c_acctbal").alias("average"),
        F.avg(F.when(F.col("c_acctbal") < -1e9, F.col("c_acctbal"))).alias("average_empty"),
        F.avg(F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit(0.0))).alias("averagea"),
    ),
    """SELECT c_nationkey, avg(c_acctbal) AS average, avg(c_acctbal) FILTER (WHERE c_acctbal < -1e9) AS average_empty,
       avg(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) AS averagea FROM customer GROUP BY c_nationkey""",
)

add(
    "d04_extremes",
    lambda s, d: _lines(s, d).groupBy("l_suppkey").agg(
        F.max("l_extendedprice").alias("largest"),
        F.min("l_extendedprice").alias("smallest"),
        F.coalesce(F.max(F.when(F.col("l_quantity") > 1000, F.col("l_quantity"))), F.lit(0.0)).alias("max_empty"),
    ),
    """SELECT l_suppkey, max(l_extendedprice) AS largest, min(l_extendedprice) AS smallest,
       coalesce(max(l_quantity) FILTER (WHERE l_quantity > 1000), 0) AS max_empty FROM lineitem GROUP BY l_suppkey""",
)

add(
    "d05_median",
    lambda s, d: _lines(s, d).groupBy("l_returnflag").agg(F.median("l_quantity").alias("median_quantity"), F.median("l_extendedprice").alias("median_price")),
    "SELECT l_returnflag, median(l_quantity) AS median_quantity, median(l_extendedprice) AS median_price FROM lineitem GROUP BY l_returnflag",
)


def _mode(s, d):
    counts = _lines(s, d).groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    return counts.groupBy("l_suppkey").agg(F.max_by("l_quantity", F.struct("n", -F.col("l_quantity"))).alias("mode"), F.max("n").alias("times"))


add(
    "d06_mode",
    _mode,
    """WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
       SELECT l_suppkey, l_quantity AS mode, n AS times FROM c
       QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1""",
)

add(
    "d07_spread",
    lambda s, d: _lines(s, d).groupBy("l_returnflag").agg(
        *[F.round(f("l_quantity"), 9).alias(n) for n, f in (("stdev_s", F.stddev_samp), ("stdev_p", F.stddev_pop), ("var_s", F.var_samp), ("var_p", F.var_pop))]
    ),
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 9) AS stdev_s, round(stddev_pop(l_quantity), 9) AS stdev_p,
       round(var_samp(l_quantity), 9) AS var_s, round(var_pop(l_quantity), 9) AS var_p FROM lineitem GROUP BY l_returnflag""",
)

add(
    "d08_percentile_inc",
    lambda s, d: _lines(s, d).groupBy("l_linestatus").agg(
        F.percentile("l_extendedprice", 0.9).alias("p90"), F.percentile("l_extendedprice", 0.25).alias("q1"), F.percentile("l_extendedprice", 0.75).alias("q3")
    ),
    """SELECT l_linestatus, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.25) AS q1,
       quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_linestatus""",
)


def _percentile_exc(s, d):
    # positions (n + 1) p among the sorted values: ranks by window, not a collected list
    from pyspark.sql import Window

    o = table(s, d, "orders").select("o_orderstatus", "o_totalprice")
    o = o.withColumns({"r": F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_totalprice")), "n": F.count("*").over(Window.partitionBy("o_orderstatus"))})
    at = (F.col("n") + 1) * F.lit(0.9)
    o = o.withColumns({"k": F.floor(at), "f": at - F.floor(at)})
    low, high = F.max(F.when(F.col("r") == F.col("k"), F.col("o_totalprice"))), F.max(F.when(F.col("r") == F.col("k") + 1, F.col("o_totalprice")))
    return o.groupBy("o_orderstatus").agg((low + F.max("f") * (high - low)).alias("p90_exc"))


add(
    "d09_percentile_exc",
    _percentile_exc,
    """WITH o AS (SELECT o_orderstatus, list_sort(list(o_totalprice)) AS x, (count(*) + 1) * 0.9 AS pos FROM orders GROUP BY o_orderstatus)
       SELECT o_orderstatus, x[CAST(floor(pos) AS INT)] + (pos - floor(pos)) * (x[CAST(floor(pos) AS INT) + 1] - x[CAST(floor(pos) AS INT)]) AS p90_exc FROM o""",
)

add(
    "d10_nearest_rank",
    lambda s, d: _lines(s, d).groupBy("l_suppkey").agg(
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice)").alias("p95"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice)").alias("p50")
    ),
    "SELECT l_suppkey, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.5) AS p50 FROM lineitem GROUP BY l_suppkey",
)

add(
    "d11_correlation",
    lambda s, d: _lines(s, d).groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("correl"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 9).alias("rsq")
    ),
    "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 9) AS correl, round(regr_r2(l_extendedprice, l_quantity), 9) AS rsq FROM lineitem GROUP BY l_returnflag",
)


def _steyx(y, x):
    return F.sqrt((F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), F.lit(2)) / F.regr_sxx(y, x)) / (F.regr_count(y, x) - 2))


add(
    "d12_regression",
    lambda s, d: _lines(s, d).groupBy("l_returnflag").agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"),
        F.round(_steyx("l_extendedprice", "l_quantity"), 4).alias("steyx"),
    ),
    """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(sqrt((regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 4) AS steyx
       FROM lineitem GROUP BY l_returnflag""",
)

add(
    "d13_covariance",
    lambda s, d: _lines(s, d).groupBy("l_linestatus").agg(F.round(F.covar_pop("l_quantity", "l_extendedprice"), 4).alias("covar_p"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("covar_s")),
    "SELECT l_linestatus, round(covar_pop(l_quantity, l_extendedprice), 4) AS covar_p, round(covar_samp(l_quantity, l_extendedprice), 4) AS covar_s FROM lineitem GROUP BY l_linestatus",
)


def _skew(s, d):
    n = F.count("o_totalprice")
    return table(s, d, "orders").groupBy("o_orderpriority").agg(
        F.round(F.skewness("o_totalprice") * F.sqrt(n * (n - 1)) / (n - 2), 6).alias("skew"), F.round(F.skewness("o_totalprice"), 6).alias("skew_p")
    )


add(
    "d14_skew",
    _skew,
    """WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd, count(*) AS n FROM orders GROUP BY ALL),
       k AS (SELECT o_orderpriority, avg(power((o_totalprice - mean) / sd, 3)) AS g, max(n) AS n FROM orders JOIN m USING (o_orderpriority) GROUP BY ALL)
       SELECT o_orderpriority, round(g * sqrt(n * (n - 1)) / (n - 2), 6) AS skew, round(g, 6) AS skew_p FROM k""",
)


def _geomean(s, d):
    from pyspark.sql import Window

    p = table(s, d, "part").select("p_brand", "p_retailprice")
    w = Window.partitionBy("p_brand")
    p = p.withColumns({"r": F.row_number().over(w.orderBy("p_retailprice")), "n": F.count("*").over(w)})
    cut = F.floor(F.col("n") * 0.1)
    return p.groupBy("p_brand").agg(
        F.round(F.exp(F.avg(F.ln("p_retailprice"))), 6).alias("geomean"),
        F.round(F.avg(F.when((F.col("r") > cut) & (F.col("r") <= F.col("n") - cut), F.col("p_retailprice"))), 6).alias("trimmean"),
    )


add(
    "d15_means",
    _geomean,
    """WITH r AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
       SELECT p_brand, round(exp(avg(ln(p_retailprice))), 6) AS geomean,
              round(avg(p_retailprice) FILTER (WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1)), 6) AS trimmean FROM r GROUP BY p_brand""",
)


def _tests(s, d):
    # Welch's t statistic between two groups, and the z statistic against a mean, from moments alone
    x = _lines(s, d).groupBy("l_returnflag").agg(
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("a"), F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("b"),
        F.var_samp(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("va"), F.var_samp(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("vb"),
        F.count_if(F.col("l_linestatus") == "O").alias("na"), F.count_if(F.col("l_linestatus") == "F").alias("nb"),
        F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("sd"), F.count("*").alias("n"),
        (F.count_if(F.col("l_quantity").between(10, 20)) / F.count("*")).alias("prob"),
    )
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    t, z = F.try_divide(F.col("a") - F.col("b"), F.sqrt(ea + eb)), (F.col("m") - 25) / (F.col("sd") / F.sqrt("n"))
    free = F.try_divide(F.pow(ea + eb, F.lit(2)), F.try_divide(F.pow(ea, F.lit(2)), F.col("na") - 1) + F.try_divide(F.pow(eb, F.lit(2)), F.col("nb") - 1))
    x = x.select("l_returnflag", t.alias("t"), z.alias("z"), free.alias("free"), "prob")
    # T.TEST, unequal variances, two tails; Z.TEST, the upper tail
    return x.select(
        "l_returnflag", F.round("t", 8).alias("t_stat"), F.round("z", 8).alias("z_stat"), "prob",
        F.round(2 * (1 - distributions.t_cdf(F.abs("t"), F.col("free"))), 8).alias("t_test"), F.round(1 - distributions.norm_cdf(F.col("z"), F.lit(0.0), F.lit(1.0)), 8).alias("z_test"),
    )


add(
    "d16_test_statistics",
    _tests,
    """WITH x AS (SELECT l_returnflag, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS a, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS b,
         var_samp(l_quantity) FILTER (WHERE l_linestatus = 'O') AS va, var_samp(l_quantity) FILTER (WHERE l_linestatus = 'F') AS vb,
         count(*) FILTER (WHERE l_linestatus = 'O') AS na, count(*) FILTER (WHERE l_linestatus = 'F') AS nb,
         avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd, count(*) AS n, count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 20) * 1.0 / count(*) AS prob
         FROM lineitem GROUP BY l_returnflag)
       , y AS (SELECT *, (a - b) / sqrt(va / na + vb / nb) AS t, (m - 25) / (sd / sqrt(n)) AS z, power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS v FROM x)
       SELECT l_returnflag, round(t, 8) AS t_stat, round(z, 8) AS z_stat, prob,
              round(1 - 2 * abs(t) / 3000 * list_sum(list_transform(range(1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * power(1 + power(t * i / 1000, 2) / v, -(v + 1) / 2))), 8) AS t_test,
              round(0.5 - z / 3000 * list_sum(list_transform(range(1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(z * i / 1000, 2) / 2) / sqrt(2 * pi()))), 8) AS z_test FROM y""",
)


def _conditional(s, d):
    q, flag = F.col("l_quantity"), F.col("l_shipmode_")
    x = _lines(s, d).withColumn("l_shipmode_", F.concat("l_returnflag", "l_linestatus"))
    many, flagged = criterion(q, ">30", True), criterion(flag, "?f", False)
    both = all_of(criterion(q, ">5", True), criterion(q, "<=40", True), criterion(flag, "<>NO", False))
    return x.groupBy("l_suppkey").agg(
        F.coalesce(F.sum(F.when(many, F.col("l_extendedprice"))), F.lit(0.0)).alias("sumif"),
        F.count_if(flagged).alias("countif"),
        F.coalesce(F.sum(F.when(both, q)), F.lit(0.0)).alias("sumifs"),
        F.count_if(both).alias("countifs"),
        F.avg(F.when(both, q)).alias("averageifs"),
        F.coalesce(F.max(F.when(many, q)), F.lit(0.0)).alias("maxifs"),
        F.coalesce(F.min(F.when(many, q)), F.lit(0.0)).alias("minifs"),
        F.avg(F.when(criterion(q, ">5000", True), q)).alias("averageif_nomatch"),
    )


add(
    "d17_conditional",
    _conditional,
    """SELECT l_suppkey, coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity > 30), 0) AS sumif,
       count(*) FILTER (WHERE lower(l_returnflag || l_linestatus) LIKE '_f') AS countif,
       coalesce(sum(l_quantity) FILTER (WHERE l_quantity > 5 AND l_quantity <= 40 AND l_returnflag || l_linestatus <> 'NO'), 0) AS sumifs,
       count(*) FILTER (WHERE l_quantity > 5 AND l_quantity <= 40 AND l_returnflag || l_linestatus <> 'NO') AS countifs,
       avg(l_quantity) FILTER (WHERE l_quantity > 5 AND l_quantity <= 40 AND l_returnflag || l_linestatus <> 'NO') AS averageifs,
       coalesce(max(l_quantity) FILTER (WHERE l_quantity > 30), 0) AS maxifs, coalesce(min(l_quantity) FILTER (WHERE l_quantity > 30), 0) AS minifs,
       avg(l_quantity) FILTER (WHERE l_quantity > 5000) AS averageif_nomatch
       FROM lineitem GROUP BY l_suppkey""",
)

add(
    "d19_pivot_counts",
    lambda s, d: table(s, d, "events").groupBy("user_id").pivot("event_type", ["signup", "purchase", "error", "view", "click"]).count().na.fill(0),
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
       count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view,
       count(*) FILTER (WHERE event_type = 'click') AS click FROM events GROUP BY user_id""",
)


def _pooling(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg((F.sum(F.col("o_totalprice") * F.col("o_orderkey")) / F.sum("o_orderkey")).alias("pooled"), F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("present"))
    return o.where("present = 3").select("o_custkey", F.round("pooled", 4).alias("pooled"), "n")


add(
    "d20_class_pooling",
    _pooling,
    """SELECT o_custkey, round(sum(o_totalprice * o_orderkey) / sum(o_orderkey), 4) AS pooled, count(*) AS n
       FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 3""",
)


def _micro(s, d):
    docs = table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("marks"))
    x = table(s, d, "labels").join(docs, "doc_id").select((F.col("marks") > 10).alias("said"), (F.col("quality") == 0).alias("bad"))
    c = lambda p: F.count_if(p)
    both = c(F.col("said") & F.col("bad"))
    return x.agg((both / c(F.col("said"))).alias("precision"), (both / c(F.col("bad"))).alias("recall"), F.count("*").alias("n"))


add(
    "d21_micro_pr",
    _micro,
    """WITH x AS (SELECT len(regexp_extract_all(text, '[#*$%&|<>]')) > 10 AS said, quality = 0 AS bad FROM labels JOIN documents USING (doc_id))
       SELECT count(*) FILTER (WHERE said AND bad) * 1.0 / count(*) FILTER (WHERE said) AS precision,
              count(*) FILTER (WHERE said AND bad) * 1.0 / count(*) FILTER (WHERE bad) AS recall, count(*) AS n FROM x""",
)

add(
    "d26_balance",
    lambda s, d: table(s, d, "events").withColumn("expires", F.when(F.col("event_id") % 3 != 0, F.expr("ts + INTERVAL 10 DAYS"))).groupBy("user_id").agg(
        F.coalesce(F.round(F.sum(F.when(F.col("expires").isNull() | (F.col("expires") > F.lit("2024-01-20").cast("timestamp")), F.col("value"))), 4), F.lit(0.0)).alias("credits"),
        F.min(F.when(F.col("expires") > F.lit("2024-01-20").cast("timestamp"), F.col("expires"))).alias("next_expiry"),
    ),
    """WITH e AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 10 DAY END AS expires FROM events)
       SELECT user_id, coalesce(round(sum(value) FILTER (WHERE expires IS NULL OR expires > TIMESTAMP '2024-01-20'), 4), 0) AS credits,
              min(expires) FILTER (WHERE expires > TIMESTAMP '2024-01-20') AS next_expiry FROM e GROUP BY user_id""",
)

add(
    "d29_variation",
    lambda s, d: _lines(s, d).groupBy("l_suppkey").agg(F.round(F.coalesce(F.stddev_samp("l_extendedprice") / F.avg("l_extendedprice"), F.lit(0.0)), 8).alias("cv"), F.avg("l_extendedprice").alias("mean")),
    "SELECT l_suppkey, round(coalesce(stddev_samp(l_extendedprice) / avg(l_extendedprice), 0), 8) AS cv, avg(l_extendedprice) AS mean FROM lineitem GROUP BY l_suppkey",
)


def _ragged(s, d):
    lines = table(s, d, "documents").select("source", "doc_id", F.size(F.split("text", ",")).alias("fields"))
    return lines.groupBy("source").agg(F.count_if(F.col("fields") > 20).alias("wide"), F.min(F.when(F.col("fields") > 20, F.col("doc_id"))).alias("first_wide"), F.max("fields").cast("long").alias("width"))


add(
    "d30_ragged_tally",
    _ragged,
    """WITH x AS (SELECT source, doc_id, len(string_split(text, ',')) AS f FROM documents)
       SELECT source, count(*) FILTER (WHERE f > 20) AS wide, min(doc_id) FILTER (WHERE f > 20) AS first_wide, max(f) AS width FROM x GROUP BY source""",
)

add(
    "d31_script_share",
    lambda s, d: table(s, d, "documents").groupBy("lang").agg(
        F.round(F.sum(F.regexp_count("text", F.lit("[À-ɏ]"))) / F.sum(F.regexp_count("text", F.lit(r"\p{L}"))), 9).alias("accented"),
        F.sum(F.regexp_count("text", F.lit("[a-z]"))).cast("long").alias("ascii_lower"),
    ),
    """SELECT lang, round(sum(len(regexp_extract_all(text, '[À-ɏ]'))) / sum(len(regexp_extract_all(text, '\\p{L}'))), 9) AS accented,
       CAST(sum(len(regexp_extract_all(text, '[a-z]'))) AS BIGINT) AS ascii_lower FROM documents GROUP BY lang""",
)

add(
    "d32_text_join",
    lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("names")),
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)


def _stats(s, d):
    c = table(s, d, "customer").withColumn("x", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return c.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(F.col("x").isNull()).alias("nulls"), F.min("c_name").alias("first_name"), F.max("c_name").alias("last_name"))


add(
    "d33_column_statistics",
    _stats,
    """WITH c AS (SELECT c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer)
       SELECT min(x) AS lo, max(x) AS hi, count(*) FILTER (WHERE x IS NULL) AS nulls, min(c_name) AS first_name, max(c_name) AS last_name FROM c""",
)

add(
    "d34_distinct",
    lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days")),
    "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type",
)


def _weighted_mode(s, d):
    x = table(s, d, "documents").select("lang", (F.col("n_chars") % 7).alias("size"), "n_chars").groupBy("lang", "size").agg(F.sum("n_chars").alias("w"))
    return x.groupBy("lang").agg(F.max_by("size", F.struct("w", "size")).alias("body_size"), F.max("w").alias("weight"))


add(
    "d35_weighted_mode",
    _weighted_mode,
    """WITH x AS (SELECT lang, n_chars % 7 AS size, CAST(sum(n_chars) AS BIGINT) AS w FROM documents GROUP BY ALL)
       SELECT lang, size AS body_size, w AS weight FROM x QUALIFY row_number() OVER (PARTITION BY lang ORDER BY w DESC, size DESC) = 1""",
)


def _dominant(s, d):
    docs = table(s, d, "documents")
    x = docs.groupBy("source", "lang").agg(F.sum("n_chars").alias("w"))
    share = x.groupBy("source").agg(F.max_by("lang", F.struct("w", "lang")).alias("lang"), (F.max("w") / F.sum("w")).alias("share"))
    middle = docs.groupBy("source").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars)").alias("middle"))
    return share.join(middle, "source")


add(
    "d36_dominant_share",
    _dominant,
    """WITH x AS (SELECT source, lang, sum(n_chars) AS w FROM documents GROUP BY ALL),
       s AS (SELECT source, lang, w / sum(w) OVER (PARTITION BY source) AS share FROM x QUALIFY row_number() OVER (PARTITION BY source ORDER BY w DESC, lang DESC) = 1),
       m AS (SELECT source, quantile_disc(n_chars, 0.5) AS middle FROM documents GROUP BY source)
       SELECT source, lang, share, middle FROM s JOIN m USING (source)""",
)

add(
    "dx_rollup_cube",
    lambda s, d: _lines(s, d).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
