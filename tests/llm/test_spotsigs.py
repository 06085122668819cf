import hashlib
import re

from quillon.llm import spotsigs
from quillon.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def spots(text):
    """Brute force: anchors with the next two content words, as strings."""
    words = [w for w in re.sub(r"[\W_]+", " ", (text or "").lower()).split(" ") if w]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain, j = [], i + 1
            while j < len(words) and len(chain) < spotsigs.CHAIN:
                chain += [] if words[j] in spotsigs.ANCHORS else [words[j]]
                j += 1
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
    return out or ({("whole", *words)} if words else set())


def like(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(out, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), len(spots(text)), len(spots(edited)), round(like(spots(text), spots(edited)), 9), round(like(spots(text), spots(after)), 9)))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], len(r["fingerprint"]) // 8, len(r["edited_fingerprint"]) // 8, round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out]
    assert sorted(got) == sorted(want)


def test_against_brute_force(spark, tables):
    rows = [(i * 3, f"The quick fox of the hill and the river {i % 7} is in the valley of dogs number {i}" * (1 + i % 3)) for i in range(300)]
    rows += [(1000, "the the the of"), (1001, ""), (1002, None), (1003, "no anchors here"), (1004, "é̀☃ the wörld of ünïcode texts"), (1005, "a")]
    d = tables("documents", [(i, t, None, None, None) for i, t in rows], SCHEMA)
    check(QUERIES["op7_spot_signatures"](spark, d).collect(), rows)


def test_odd_rows(spark, odd_dir, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    out = QUERIES["op7_spot_signatures"](spark, odd_dir).collect()
    check(out, rows)
    prints = {}
    for (_, text), r in zip(sorted(rows, key=str), sorted(out, key=lambda r: str((r["doc_id"],))), strict=True):
        prints.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert prints


def test_long_runs_of_anchors(spark, tables):
    d = tables("documents", [(1, "the " * 200_000 + "end of it all here", None, None, None)], SCHEMA)
    assert QUERIES["op7_spot_signatures"](spark, d).collect()[0]["near_next"] == 1.0


def test_near_duplicates_against_brute_force(spark):
    base = [f"the word{i} thing{i} of red{i} stone{i} and blue{i} leaf{i} in grey{i} sky{i} for old{i} men{i} by cold{i} sea{i}" for i in range(25)]
    texts = base + [b + f" with extra{i} tail{i}" for i, b in enumerate(base)] + base[:4] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs, members = spotsigs.near_duplicates(df, least=0.8)
    cls = {r["id"]: r["class"] for r in members.collect()}
    got = {frozenset((r["a"], r["b"])) for r in pairs.collect()}
    want = {frozenset((cls[i], cls[j])) for i in range(len(texts)) for j in range(i) if spots(texts[i]) and cls[i] != cls[j] and like(spots(texts[i]), spots(texts[j])) >= 0.8}
    assert got == want and want


def test_spots_in_other_languages(spark):
    texts = [
        "To jest dom, który stoi na wzgórzu, i nie ma w nim nikogo, ale przez okno widać się las",
        "Это был дом на холме, и в нём не было никого, но из окна был виден лес",
        "Bu ev bir tepenin üzerinde duruyor ve içinde kimse yok ama pencereden çok güzel bir orman görünüyor",
        "Talo on mäellä ja siellä ei ole ketään mutta ikkunasta näkyy metsä joka oli vanha niin kuin talo",
    ]
    df = spark.createDataFrame([(t, t + " xyz") for t in texts], "a string, b string")
    df = spotsigs.with_signatures(spotsigs.with_signatures(df, df.a, "x"), df.b, "y")
    for r in df.select("x", "y", spotsigs.likeness(df["x"], df["y"]).alias("l")).collect():
        assert len(r["x"]) > 2 and r["l"] > 0.5


def test_near_duplicates_of_texts_without_anchors(spark):
    base = [" ".join(f"q{i}k{k}" for k in range(60)) for i in range(10)]
    texts = base + [b.rsplit(" ", 1)[0] + " other" for b in base] + ["lone pair", "pair"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, members = spotsigs.near_duplicates(df, least=0.8)
    cls = {r["id"]: r["class"] for r in members.collect()}
    assert {frozenset((r["a"], r["b"])) for r in pairs.collect()} == {frozenset((cls[i], cls[i + 10])) for i in range(10)}


def test_ids_of_text_and_one_id_of_many_rows(spark):
    from pyspark.sql import functions as F

    rows = [(f"k{i:04}", f"text of the number {i} in the row") for i in range(200)] + [("k0100", f"one of the many texts {i}") for i in range(300)]
    rows += [(None, f"no id at all in the row {i}") for i in range(300)] + [("k0100", "the same row of the table")] * 50
    df = spark.createDataFrame(rows, "doc_id string, text string")
    hashed = df.select("doc_id", F.xxhash64("text"), "text").collect()
    order = sorted(map(tuple, hashed), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    want = []
    for k, (doc, _, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][2], len(text) // 2
        want.append((str(doc), text, text[: len(text) - half] + after[:half]))
    got = spotsigs.edited_texts(df).select("id", "text", "edited").collect()
    assert sorted((str(r["id"]), r["text"], r["edited"]) for r in got) == sorted(want)
    sizes = [r["count"] for r in spotsigs.with_next(df, "doc_id", "text").where("not ghost").groupBy("range").count().collect()]
    assert max(sizes) <= 200
