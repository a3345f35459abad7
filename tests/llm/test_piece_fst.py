import random

import public_tokenizers
import pytest
import sentencepiece

from awkward import documents, empty
from lamplight.llm import piece_fst as pf

PATH = public_tokenizers.path(pf.MODEL)


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_library(spark, lib):
    docs = documents(spark)
    rows = pf.encode_pieces(docs).collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    want = sorted(((r.doc_id, lib.encode(r.text or "")) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in rows), key=repr) == want
    assert all(r.n_pieces == len(r.ids) for r in rows)
    assert pf.encode_pieces(empty(spark)).count() == 0


def test_random_strings(lib):
    rng = random.Random(4)
    fst = pf.load(PATH)
    pieces = list(fst.ids)
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))).replace(pf.MARK, " ")
        assert fst.encode(t).tolist() == lib.encode(t), t
    for _ in range(1500):
        t = "".join(rng.choice("aabeth in\n\t é①ﬁ漢字😀\x00<>/()=_-#*1234567890  ▁") for _ in range(rng.randint(0, 60)))
        assert fst.encode(t).tolist() == lib.encode(t), t
        assert fst.decode(fst.encode(t).tolist()) == t.replace(pf.MARK, " ")
    for k in range(80):
        for t in (" " * k, f"a{' ' * k}b", f"\n{' ' * k}the", "-" * k, "=" * k):
            assert fst.encode(t).tolist() == lib.encode(t), t


def test_both_searches_find_the_same_path():
    fst = pf.load(PATH)
    rng = random.Random(6)
    for _ in range(500):
        s = pf.MARK + "".join(rng.choice("thereinandofg") for _ in range(rng.randint(1, 30)))
        assert fst.finite_path(s) == fst.merged(s)
        ids, n = fst.paths([s, "x"])
        assert ids[: n[0]].tolist() == [fst.ids[p] for p in fst.merged(s)]


def test_unigram_lattice():
    """The least path of a unigram model against all segmentations."""
    fst = pf.load(PATH)
    small = object.__new__(pf.PieceFst)
    small.score = {"a": -1.0, "b": -1.5, "ab": -2.0, "aba": -2.2, "ba": -1.9, "c": -3.0}
    small.longest = 3
    small.ids = {p: k for k, p in enumerate(small.score)}

    def every(s):
        if not s:
            return [[]]
        return [[s[:k], *rest] for k in range(1, 4) if s[:k] in small.score for rest in every(s[k:])] if s else []

    rng = random.Random(3)
    for _ in range(100):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        cost = lambda p: -sum(small.score[x] for x in p)
        assert abs(cost(small.least_path(s)) - min(map(cost, every(s)))) < 1e-9
    assert fst.merging


def test_decoding_table(spark):
    docs = documents(spark, ["a b", "", None, "é漢😀"])
    back = {r.doc_id: r.text for r in pf.decode_pieces(pf.encode_pieces(docs)).collect()}
    assert back == {0: "a b", 1: "", 2: "", 3: "é漢😀"}


def test_caches_are_bounded(monkeypatch, lib):
    monkeypatch.setattr(pf, "KEPT_SEGMENTS", 20)
    monkeypatch.setattr(pf, "KEPT_PAIRS", 5)
    fst = pf.PieceFst(PATH)
    rng = random.Random(2)
    for _ in range(50):
        t = " ".join("".join(rng.choice("thereinand") for _ in range(6)) for _ in range(10))
        assert fst.encode(t).tolist() == lib.encode(t)
