import random

import pytest

from quillon.llm import neardup
from quillon.llm.components import connected
from quillon.llm.queries import QUERIES
from quillon.llm.shingles import WordHashes, class_key, intersection, shingle_set, signature

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    """Brute force: the contract's set, as strings."""
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    for b in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([b]), b" ")
    words = [w for w in words.split(b" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = (min(ids) if ids else None) if sets[i] else doc
        out.append((doc, len(sets[i]), least, doc is not None and doc == least))
    return out


def family(rng, n, words, changes):
    """A group of near copies that straddles the threshold."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(changes + 1)):
            t[rng.randrange(words)] = f"c{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_against_brute_force(spark, tables):
    rng = random.Random(11)
    texts = [t for k in range(12) for t in family(rng, 14, rng.choice([30, 80, 200]), rng.choice([1, 2, 4]))]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)] + [texts[3]] * 9
    boiler = " ".join(f"b{i}" for i in range(60))
    texts += [boiler + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.choice([5, 9, 60]))) for _ in range(40)]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    d = tables("documents", [(i, t, None, None, None) for i, t in rows], SCHEMA)
    out = QUERIES["op6_minhash_components"](spark, d).collect()
    assert sorted(map(tuple, out)) == sorted(brute(rows))


def test_odd_rows(spark, odd_dir, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    out = QUERIES["op6_minhash_components"](spark, odd_dir).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, brute(rows)))


def test_blocks_of_a_long_list(spark, tables, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(4)
    rows = list(enumerate(family(rng, 60, 60, 3)))
    d = tables("documents", [(i, t, None, None, None) for i, t in rows], SCHEMA)
    out = QUERIES["op6_minhash_components"](spark, d).collect()
    assert sorted(map(tuple, out)) == sorted(brute(rows))


def test_one_row_of_each_group_stays(spark, odd_docs):
    kept = neardup.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    groups = {}
    for (doc, text), (_, n, least, _) in zip(rows, brute(rows), strict=True):
        if n:
            groups.setdefault(least, []).append((doc, text))
    for least, members in groups.items():
        assert [g for g in got if g in members] == [(least, next(t for i, t in members if i == least))]
    assert [g for g in got if not shingles(g[1])] and sum(not shingles(t) for _, t in got) == sum(not shingles(t) for _, t in rows)


def kept_texts(spark, rows):
    return sorted(((str(r["doc_id"]), r["text"]) for r in neardup.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


def test_rows_without_an_id_are_merged_only_in_their_group(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2] + " end"), (None, ""), (None, None), (None, " ")]
    rows += [(1, texts[3]), (None, texts[3]), (2, texts[4]), (None, texts[4].upper())]
    got = kept_texts(spark, rows)
    texts_of = [t for i, t in got if i == "None"]
    assert {texts[0], texts[1], "", " ", None} <= set(texts_of) and len(texts_of) == 6
    assert sum(t in (texts[2], texts[2] + " end") for t in texts_of if t) == 1
    assert [g for g in got if g[0] != "None"] == [("1", texts[3]), ("2", texts[4])]


def test_a_repeated_id_keeps_its_unlinked_texts(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(5)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[2]), (7, None), (7, ""), (3, texts[2]), (9, texts[3]), (9, texts[3]), (9, texts[3].upper()), (8, texts[4])]
    want = [("3", texts[2]), ("7", ""), ("7", None), ("7", texts[0]), ("7", texts[1]), ("8", texts[4]), ("9", texts[3].upper())]
    assert sorted(kept_texts(spark, rows), key=str) == sorted(want, key=str)


def test_coordinates_follow_from_the_similarity():
    assert [neardup.matches(p) for p in (100, 85, 80, 70, 50, 15)] == [64, 42, 38, 30, 17, 1]
    with pytest.raises(ValueError):
        neardup.matches(14)


def test_pairs_at_lower_similarities_against_brute_force(spark):
    rng = random.Random(12)
    for percent, own in ((80, 100), (50, 44)):  # shingles of a pair: 96 of 120 are common, or 40 of 80
        rows = []
        for k in range(250):
            base = [f"w{rng.randrange(10**6)}" for _ in range(own)]
            more = [f"w{rng.randrange(10**6)}" for _ in range(12 if percent == 80 else 20)]
            less = [f"w{rng.randrange(10**6)}" for _ in range(len(more))]
            rows += [(2 * k, " ".join(base + more)), (2 * k + 1, " ".join(less + base))]
        found = neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
        want = {(i, i - i % 2) for i in range(500)}
        assert {(doc, least) for doc, _, least, _ in brute(rows[:20], percent)} == {w for w in want if w[0] < 20}
        assert {(r["id"], r["component"]) for r in found} == want


def test_kernel():
    known = WordHashes()
    rng = random.Random(1)
    for _ in range(50):
        a = " ".join(rng.choice(["A", "b", "Cc", "é", "d\t"]) for _ in range(rng.randrange(0, 30)))
        b = a + " z q"
        x, y = shingle_set(a.encode(), known), shingle_set(b.encode(), known)
        assert len(x) == len(shingles(a)) and intersection(x, y) == len(shingles(a) & shingles(b))
        assert (class_key(x) == class_key(y)) == (shingles(a) == shingles(b))
        if len(x):
            assert len(signature(x)) == 64


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    out = {r[0]: r[1] for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert out == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}}
