import os
import random
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))
import numpy as np
import pytest

from awkward import documents, empty
from lamplight.llm import phrases as ph


def brute(rows, least, top):
    words, grams = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in (1, 2, 3):
                grams.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {}
    for (lang, g), a in grams.items():
        if len(g) < 2 or a < least:
            continue
        score, k = min((10**6 * a * a // (grams[lang, g[:k]] * grams[lang, g[k:]]), k) for k in range(1, len(g)))
        found.setdefault(lang, {})[g] = (score, a, grams[lang, g[:k]], grams[lang, g[k:]])
    out = []
    for lang, some in found.items():
        dropped = {g[i : i + 2] for g, x in some.items() if len(g) == 3 for i in (0, 1) if 100 * x[1] >= 50 * some[g[i : i + 2]][1]}
        rest = sorted(((-x[0], -x[1], " ".join(g).encode()), g, x) for g, x in some.items() if g not in dropped)[:top]
        out += [(lang, r, " ".join(g), a, left, right, words[lang], score) for r, (_, g, (score, a, left, right)) in enumerate(rest, 1)]
    return sorted(out)


def phrases_of(docs, least, top):
    return sorted(map(tuple, ph.collocations(docs, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def rows_of(docs):
    return [(r.lang, r.text) for r in docs.collect()]


def repetitive(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "B", "c", "\x01x", "b\x01", "é", "漢字", "d"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!\x0b"]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("least, top", [(2, 5), (3, 2000), (10, 4)])
def test_equals_brute_force(spark, least, top):
    docs = documents(spark, repetitive(least, 60))
    want = brute(rows_of(docs), least, top)
    assert want and phrases_of(docs, least, top) == want


def test_awkward_tables(spark):
    docs = documents(spark)
    assert phrases_of(docs, 2, 50) == brute(rows_of(docs), 2, 50)
    assert phrases_of(docs, 10, 2000) == brute(rows_of(docs), 10, 2000)
    assert ph.collocations(empty(spark)).count() == 0
    assert ph.collocations(documents(spark, [None, "", "one"])).count() == 0


def test_ties_at_the_last_place(spark):
    """Many phrases of one score and count: the bytes of the phrase decide, across salted parts."""
    docs = documents(spark, [f"w{k:03} v{k:03}. " * 3 for k in range(300)], ids=[3 * k for k in range(300)])
    want = brute(rows_of(docs), 3, 7)
    assert phrases_of(docs, 3, 7) == want and len(want) == 21


def test_small_blocks_and_ranges_change_nothing(spark, monkeypatch):
    docs = documents(spark, repetitive(7, 80)).repartition(5)
    want = brute(rows_of(docs), 3, 100)
    for name, value in (("BLOCK_BYTES", 300), ("RANGE_KEYS", 64), ("STRIDE", 4), ("PIECE_BYTES", 50)):
        monkeypatch.setattr(ph, name, value)
    # tasks take module values from here: the functions travel with what they read
    monkeypatch.setattr(ph, "_streams", _local(ph._streams, ph))
    monkeypatch.setattr(ph, "_windows", _local(ph._windows, ph))
    assert phrases_of(docs, 3, 100) == want


def _local(f, module):
    values = {k: getattr(module, k) for k in ("BLOCK_BYTES", "RANGE_KEYS", "STRIDE", "PIECE_BYTES")}

    def run(batches):
        from lamplight.llm import phrases

        before = {k: getattr(phrases, k) for k in values}
        for k, v in values.items():
            setattr(phrases, k, v)
        try:
            yield from getattr(phrases, f.__name__)(batches)
        finally:
            for k, v in before.items():
                setattr(phrases, k, v)

    return run


def test_keys_sort_and_pack():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 18, 1 << 40):
        a, b, c = (rng.integers(0, most, 500, dtype=np.uint64) for _ in range(3))
        high, low = ph.keys_of(a, b, c)
        assert all((x == y).all() for x, y in zip(ph.ids_of(high, low), (a, b, c)))
        order = ph.radix_order(high, low)
        assert list(zip(a[order].tolist(), b[order].tolist(), c[order].tolist())) == sorted(zip(a.tolist(), b.tolist(), c.tolist()))
        assert all((x == y).all() for x, y in zip(ph.unpack(ph.pack(a, b, c)), (a, b, c)))
        h, v, n = ph.run_lengths(high, low)
        assert n.sum() == 500 and len(h) == len(set(zip(a.tolist(), b.tolist(), c.tolist())))
        assert all((x == y).all() for x, y in zip(ph._unrun(ph._run(h, v, n)), (h, v, n)))
        cuts = (high[order][::50], low[order][::50])
        keys = list(zip(high[order].tolist(), low[order].tolist()))
        assert ph.places_of(high[order], low[order], cuts).tolist() == [sum(k < x for k in keys) for x in zip(cuts[0].tolist(), cuts[1].tolist())]


def test_scores_are_exact(spark):
    cases = [(10**12, 10**12, 10**12), (10**12 - 1, 10**12, 10**12 + 7), (999_999_999_989, 999_999_999_999, 10**12), (10, 10**12, 10**12), (7, 9, 11)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in df.select("a", "l", "r", ph._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [(a, left, right, 10**6 * a * a // (left * right)) for a, left, right in cases]
