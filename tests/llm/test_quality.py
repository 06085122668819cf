import random
import re

from pyspark.sql import functions as F

from quillon.llm import quality
from quillon.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_measures_against_brute_force(spark, tables):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    texts += ["\n".join(rng.choice(["same line of words", "other line", " ", ""]) for _ in range(12)) for _ in range(30)]
    texts += [None, "", "\x0b\x0c", "é☃ " * 30, "# * $ % & | < > " * 9, ("one two three four five six seven eight " * 3).strip(), "x" * 100_000, "w " * 50_000]
    texts += [" ".join(f"n{i}" for i in range(60)) + " " + " ".join(f"n{i}" for i in range(20, 40))]
    d = tables("documents", [(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    out = {r["doc_id"]: r for r in QUERIES["op10_quality_cascade"](spark, d).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), (i, t)
        assert not (r["kept"] and r["base_failed"])


def _verdicts(spark, rules, docs):
    return {r["doc_id"]: r[quality.P + "kept"] for r in quality.judge(docs.where("doc_id IS NOT NULL"), rules=rules).collect()}


def test_order_does_not_change_the_verdict(spark, odd_docs):
    rules = quality.default_rules()
    assert _verdicts(spark, rules, odd_docs) == _verdicts(spark, rules[::-1], odd_docs) == _verdicts(spark, rules[3:] + rules[:3], odd_docs)


def test_named_rule_does_not_depend_on_the_measured_order(spark, monkeypatch):
    texts = [" ".join(["AB##!!"] * 3 + [f"W{i}!!##" for i in range(40)]), " ".join(f"| {i}#" for i in range(30)), " ".join(f"word{i}" for i in range(30)), "few"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = lambda: {r["doc_id"]: r[quality.P + "failed_rule"] for r in quality.judge(docs).collect()}
    real = quality.ordered
    first = named()
    monkeypatch.setattr(quality, "ordered", lambda e: real(e)[::-1])
    assert first == named() == {0: "symbols", 1: "symbols", 2: None, 3: "base"}


def test_order_is_by_rejection_per_cost():
    r = [quality.Rule(n, (), None) for n in "abc"]
    assert [x.name for x in quality.ordered([(r[0], 0.1, 1.0), (r[1], 0.5, 2.0), (r[2], 0.0, 0.1)])] == ["b", "a", "c"]


def test_cost_includes_the_measures(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cost = {r.name: c for r, _, c in quality.estimate(docs, quality.base_rules() + quality.default_rules())}
    assert cost["repeats"] > 2 * cost["shouting"]


def test_sample_is_not_the_head_of_a_sorted_table(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, F.repeat(F.lit("# "), 30)).otherwise(F.repeat(F.lit("word "), 30)).alias("text"))
    share = {r.name: x for r, x, _ in quality.estimate(docs.coalesce(1), quality.default_rules())}
    assert 0.4 < share["symbols"] < 0.6


def test_keep_agrees_with_judge(spark, odd_docs):
    own = ["doc_id", "text", "source"]
    judged = [r[:3] for r in quality.judge(odd_docs).select(*own, quality.P + "kept").collect() if r[3]]
    assert sorted(map(str, judged)) == sorted(str(r[:3]) for r in quality.keep(odd_docs).select(*own).collect())


def test_rules_without_windows_never_make_them(spark, odd_docs):
    """The windows of eight words stand behind the tests that come before them, not before."""
    few, repeats = quality.base_rules()
    plan = quality.cascade(odd_docs.select("text"), [few, repeats], "text")._jdf.queryExecution().optimizedPlan().toString()
    guard = plan.index("zip_with")
    assert "CASE WHEN" in plan[:guard] and "isnull(" in plan[:guard]


def test_clean_prose_stays_and_junk_goes(spark):
    rng = random.Random(3)
    clean = [" ".join(f"{rng.choice(['river', 'stone', 'light', 'Über', 'été'])}{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}" for _ in range(80)) + "." for _ in range(20)]
    junk = [" ".join(f"{w}###" for w in c.split()) for c in clean] + [" | ".join(c.split()) for c in clean] + [" ".join(w.upper() + "!!" for w in c.split()) for c in clean] + [" ".join(str(rng.randrange(10**6)) for _ in range(60))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.keep(docs).collect()}
    assert kept == set(range(len(clean)))


def test_keep_gives_the_columns_of_the_input(spark, odd_docs):
    kept = quality.keep(odd_docs)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()
