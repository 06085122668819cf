"""Every query runs on the smallest tables and equals its SQL twin there."""

import math

import pytest

import __spark_entry__ as entry
from quillon.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LOADED = catalog.load()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        x = float(v)
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v


@pytest.mark.parametrize("name", sorted(LOADED.queries))
def test_query(spark, duck, name):
    df = LOADED.queries[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in LOADED.oracles:
        assert rows
        return
    out = duck.execute(LOADED.oracles[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=repr)
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
