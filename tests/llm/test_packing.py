import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import packing
from quillon.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(PATH)


@given(st.text(max_size=60) | st.text(alphabet="aéÉßñ'’.,!#|<>s lLvV\u0301\u00a0\t\n012", max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_tokenisers(text):
    known = test_ids_are_the_tokenisers.known = getattr(test_ids_are_the_tokenisers, "known", None) or packing.WordIds(PATH)
    got = np.frombuffer(packing.word_tokens(text, known), "<u2").tolist()
    assert got == [*known.encode(text), 1]


def test_subset_is_closest():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 60)
        reach = {0}
        for n, c in counts.items():
            reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= room}
        got = packing.subset(counts, room)
        assert sum(n * c for n, c in got.items()) == max(reach)
        assert all(c <= counts[n] for n, c in got.items())


@given(st.lists(st.integers(1, 63), max_size=200))
@settings(max_examples=150, deadline=None)
def test_each_piece_once_and_little_padding(lengths):
    seqs = packing.pack(lengths, 64)
    covered = defaultdict(list)
    for seq in seqs:
        assert sum(n for _, _, n in seq) <= 64
        for i, s, n in seq:
            covered[i].append((s, n))
    assert set(covered) == set(range(len(lengths)))
    for i, parts in covered.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at and n > 0
            at += n
        assert at == lengths[i]
    assert sum(sum(n for _, _, n in q) < 64 for q in seqs) <= 1


def test_query_round_trip(spark, odd_dir, odd_docs, words):
    out = QUERIES["op4_minimum_bin_slack"](spark, odd_dir).collect()
    want = defaultdict(int)
    for r in odd_docs.select("doc_id", "text").collect():
        want[(r["doc_id"], tuple([*words.encode(r["text"] or ""), 1]))] += 1
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r["length"] for r in out) == total
    for (doc, ids), _ in want.items():
        mine = [r for r in out if r["doc_id"] == doc and r["doc_tokens"] == len(ids)]
        digests = {(r["start"], r["length"]): r["ids_crc32"] for r in mine}
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for (s, n), c in digests.items())
        assert sum(r["length"] for r in mine) % len(ids) == 0
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 2048
