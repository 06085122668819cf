"""Overlaps are counted without making pairs, and equal those of all pairs."""

import random

from pyspark.sql import functions as F

from quillon.operators import intervals


def _brute(rows):
    out = {}
    for i, a0, a1 in rows:
        later = [j for j, b0, b1 in rows if i < j and a0 < b1 and b0 < a1]
        if later:
            n, last = out.get(i, (0, i))
            out[i] = (n + len(later), max(last, *later))
    return out


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(5)
    for trial, (span, longest) in enumerate(((40, 9), (300, 200), (1000, 30))):
        rows = []
        for i in rng.sample(range(-400, 400), 300):
            x = rng.randint(-span, span) / 2
            rows.append((i, x, x + rng.choice([rng.randint(1, longest), rng.randint(1, 4) / 2, 0, -rng.randint(0, 6)])))
        rows += [(rows[0][0], *rows[1][1:])]  # a key twice
        df = spark.createDataFrame([*rows, (None, 0.0, 9.0), (900 + trial, None, 3.0), (950, float("nan"), float("nan"))], "id int, x0 double, x1 double")
        got = {r["id"]: (r["overlaps"], r["last"]) for r in intervals.overlaps(df, "id", "x0", "x1", 16).collect()}
        assert got == _brute(rows)


def test_overlaps_of_one_crowded_place(spark):
    # 200,000 boxes on 50 places make 20 billion pairs
    n = 200_000
    df = spark.range(n).select("id", (F.col("id") % 50).cast("double").alias("x0")).withColumn("x1", F.col("x0") + 50)
    out = intervals.overlaps(df, "id", "x0", "x1", 64)
    assert out.count() == n - 1
    assert out.agg(F.sum("overlaps"), F.min("last"), F.max("last")).collect()[0][:] == (n * (n - 1) // 2, n - 1, n - 1)


def test_interval_query_joins_no_pairs(spark):
    from quillon.plans import catalog

    df = catalog.load().queries["c18_interval_join"](spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_islands_of_fractions_and_nulls(spark, tmp_path):
    import duckdb

    from quillon.plans import catalog

    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([*range(-40, 40), None]), rng.choice([0.5, 1.5, 2.5, 7.3, 8.8, -2.5, None])) for _ in range(600)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    made = catalog.load()
    for name in ("e11_islands", "i09_coverage"):
        df = made.queries[name](spark, str(tmp_path))
        c = duckdb.connect()
        c.execute("SET threads=1")  # the twin's two windows sort equal intervals alike
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(c.execute(made.oracles[name]).fetchall(), key=repr)


def test_islands_are_sorted_once(spark):
    df = intervals.merge(spark.range(9).select((F.col("id") % 2).alias("k"), "id", (F.col("id") + 3).alias("e")), ["k"], "id", "e")
    assert df._jdf.queryExecution().sparkPlan().toString().count("Window ") == 2
    assert df._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
