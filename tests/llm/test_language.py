import numpy as np
from pyspark.sql import functions as F

from quillon.llm import language
from quillon.llm.queries import QUERIES

SAMPLE = {
    "en": "the house and the garden with a small tree that was growing there for many years of sun ",
    "fr": "la maison et le jardin avec un petit arbre qui était là depuis des années de soleil été ",
    "de": "das Haus und der Garten mit einem kleinen Baum der dort seit vielen Jahren wächst über ",
}


def _docs(spark, n=240):
    rows = []
    for i in range(n):
        lang = list(SAMPLE)[i % 3]
        words = SAMPLE[lang].split()
        rows.append((i, " ".join(words[(i * 7 + k * 5) % len(words)] for k in range(40)), lang, "s", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy_and_fold(spark, tmp_path):
    docs = _docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op2_byte_cnn_language"](spark, str(tmp_path)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)


def test_learning_reads_no_held_out_row(spark):
    docs = _docs(spark)
    changed = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(changed)
    assert a.labels == b.labels and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_odd_texts(spark, odd_docs):
    net = language.fit(odd_docs)
    out = {(r["doc_id"], r["text"]): r for r in language.predict(odd_docs, net).collect()}
    for key in ((100, None), (101, ""), (102, "   \n\t "), (103, "1234 5678")):
        assert out[key][language.P + "lang"] == "und" and out[key][language.P + "score"] == 0
    assert out[(110, "ONE two")][language.P + "lang"] in net.labels
    assert set(odd_docs.columns) < set(language.predict(odd_docs, net).columns)


def test_nothing_to_learn_from(spark, odd_docs):
    none = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.fit(none) is None
    assert {r[0] for r in language.predict(none, None).select(language.P + "lang").collect()} == {"und"}


def test_whole_text_is_read():
    net = language.ByteCNN(["a", "b"])
    x, f = language.windows(b"z" * (language.WINDOW * 3 + 5))
    assert x.shape == (4, language.WINDOW) and f.tolist() == [256, 256, 256, 5]
    long = b"abc" * 400_000
    labels, score = net.predict([long, b"abc"])
    plain = net.logits(language.windows(long)[0])
    w = language.windows(long)[1]
    z = (plain * w[:, None]).sum(0) / w.sum()
    p = np.exp(z - z.max())
    assert np.isclose(score[0], (p / p.sum()).max(), atol=1e-5)
