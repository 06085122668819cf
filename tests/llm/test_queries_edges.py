"""Every query on an empty table, and its row law on odd rows."""

import pytest

from quillon.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.split("_")[0] in ("op2", "op3", "op6", "op7", "op9", "op10")])
def test_one_row_for_each_document(spark, odd_dir, odd_docs, name):
    out = QUERIES[name](spark, odd_dir).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in odd_docs.select("doc_id").collect())


def test_twins_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [f"op{i}_" for i in range(1, 11)] == sorted((n.split("_")[0] + "_" for n in QUERIES), key=lambda n: int(n[2:-1]))
