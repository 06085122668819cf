import corpus_pipeline as pipeline
import pytest

from quillon.llm import language, mixing, neardup, quality

NAMES = ["language_id", "quality_rules", "near_dedup", "mixing", "packing"]


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == NAMES and pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_odd_rows(spark, odd_docs, tmp_path, stage):
    name, fn = pipeline.STAGES[stage]
    out = fn(spark, odd_docs, str(tmp_path))
    assert name == "packing" or out.columns == odd_docs.columns
    assert out.count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_an_empty_table(spark, odd_docs, tmp_path, stage):
    assert pipeline.STAGES[stage][1](spark, odd_docs.limit(0), str(tmp_path)).count() == 0


def test_decisions_take_effect(spark, odd_docs, tmp_path):
    d = str(tmp_path)
    lang = pipeline.identify_language(spark, odd_docs, d)
    ids = lambda df: sorted(str(r[0]) for r in df.select("doc_id").collect())
    assert not {"100", "101", "102", "103"} & set(ids(lang))
    assert {str(i) for i in range(30)} <= set(ids(lang))
    good = pipeline.apply_quality(spark, lang, d)
    assert set(ids(good)) == {str(r["doc_id"]) for r in quality.judge(lang).collect() if r[quality.P + "failed_rule"] is None}
    one = pipeline.drop_near_duplicates(spark, good, d)
    n = neardup.components(good).select("component").distinct().count()
    assert one.count() == n
    mixed = pipeline.mix_sources(spark, one, d)
    assert mixed.count() == sum(len(r[0]) for r in mixing.deal(one).select(mixing.P + "copies").collect())


def test_run_is_the_stages_in_a_row(spark, odd_dir):
    out = pipeline.run(spark, odd_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for _, fn in pipeline.STAGES:
        docs = fn(spark, docs, odd_dir)
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(out) == key(docs)
    assert language.P not in "".join(out.columns)


def test_near_duplicates_from_four_fifths_on_go(spark, tmp_path):
    words = [f"w{i}" for i in range(1000)]
    pairs = [(100, 12), (100, 10), (100, 14)]  # words in common and own: similarities of 96/120, 96/116 and 96/124
    rows = []
    for k, (both, own) in enumerate(pairs):
        base = [f"{w}x{k}" for w in words[:both]]
        rows += [(2 * k, " ".join(base + [f"a{i}x{k}" for i in range(own)])), (2 * k + 1, " ".join([f"b{i}x{k}" for i in range(own)] + base))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 5]
