import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from awkward import documents, empty, prose
from lamplight.llm import near_dedup as nd


def labelled(text):
    w = nd.WORD.findall((text or "").lower())
    grams = [tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))] if w else []
    seen, out = {}, []
    for g in grams:
        seen[g] = seen.get(g, -1) + 1
        out.append((g, seen[g]))
    return out


def chain(a, b):
    """Longest rising chain of common labelled shingles, by the plain table."""
    at = {g: k for k, g in enumerate(b)}
    js = [at[g] for g in a if g in at]
    best = []
    for j in js:
        best.append(1 + max((m for m, i in zip(best, js, strict=False) if i < j), default=0))
    return max(best, default=0)


def brute(rows, s=0.8):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    g = [labelled(r.text) for r in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i].doc_id, rows[j].doc_id
        if a is None or b is None or not g[i] or not g[j]:
            continue
        if a == b or (min(len(g[i]), len(g[j])) >= s * max(len(g[i]), len(g[j])) and (m := chain(g[i], g[j])) / (len(g[i]) + len(g[j]) - m) >= s):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r.doc_id)
    return sorted(((r.doc_id, least.get(find(i)) if r.doc_id is not None else None) for i, r in enumerate(rows)), key=repr)


def classes(df):
    rows = nd.near_groups(df).collect()
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)
    return sorted(((r.doc_id, r.class_id) for r in rows), key=repr)


def test_awkward(spark):
    docs = documents(spark)
    assert classes(docs) == brute(docs.collect())
    assert nd.near_groups(empty(spark)).count() == 0


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], ["new"], [out[k], "put"]])
    return " ".join(out)


def test_clouds_chains_and_shared_passages(spark):
    rng = random.Random(11)
    rows = [prose(rng, 80) for _ in range(20)]
    for share in (0.005, 0.02, 0.04):
        base = prose(rng, 250).split()
        rows += [edited(rng, base, share) for _ in range(15)]
    chain_text = prose(rng, 200).split()
    for k in range(8):  # each like the next, the first unlike the last
        rows.append(" ".join([*chain_text[: 200 - 12 * k], *prose(random.Random(k), 12 * k).split()]))
    shared = prose(rng, 60)
    rows += [f"{shared} {prose(rng, 50)}" for _ in range(15)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    docs = documents(spark, rows, ids=ids)
    assert classes(docs) == brute(docs.collect())


def test_drop_keeps_columns(spark):
    docs = documents(spark)
    out = nd.drop_near_copies(docs)
    assert out.columns == docs.columns
    keep = {i for i, c in classes(docs) if i == c}
    assert {r.doc_id for r in out.collect()} == keep


def test_alignment_equals_table():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        a = rng.permutation(60)[:n].astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 5))):
            k = int(rng.integers(0, len(b)))
            b = [np.delete(b, k), np.insert(b, k, 100 + rng.integers(0, 900)), np.roll(b, 1)][int(rng.integers(0, 3))].astype(np.uint64)
            if len(b) == 0:
                b = np.array([1], np.uint64)
        b = np.array(list(dict.fromkeys(b.tolist())), np.uint64)
        m = chain(a.tolist(), b.tolist())
        s = m / (len(a) + len(b) - m)
        got = nd.aligned(a, b)
        assert abs(got - s) < 1e-12 if s >= 0.8 else got == 0


def test_shingles_equal_plain_ones():
    texts = ["a b c d e f a b c d e", "one two", "", "x " * 20]
    h, n = nd.shingles([nd.WORD.findall(t) for t in texts])
    want = [labelled(t) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    flat = [(k, x) for w in want for k, x in enumerate(w)]
    code = {}
    for v, (_, x) in zip(h.tolist(), flat, strict=True):
        assert code.setdefault(x, v) == v
    assert len(set(code.values())) == len(code)


def test_recall_of_keys():
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(400)]
    near = [edited(rng, t.split(), 0.015) for t in base]
    h, n = nd.shingles([nd.WORD.findall(t.lower()) for t in base + near])
    keys, _ = nd.signatures(h, n)
    ends = np.cumsum(n)
    good = [k for k in range(400) if nd.aligned(h[ends[k] - n[k] : ends[k]], h[ends[400 + k] - n[400 + k] : ends[400 + k]]) > 0]
    assert len(good) > 200 and all((keys[k] == keys[400 + k]).any() for k in good)


def test_sketch_loses_less_than_the_tables():
    from math import ceil, comb

    refused = sum(comb(nd.BINS, k) * 0.8**k * 0.2 ** (nd.BINS - k) for k in range(ceil(nd.PROMISING * nd.BINS)))
    assert refused < (1 - 0.8**nd.KEPT) ** nd.TABLES / 100


def test_a_pair_of_a_low_estimate_is_verified():
    import pyarrow as pa

    a = np.ones(nd.BINS, np.uint8)
    b = np.where(np.arange(nd.BINS) < 0.68 * nd.BINS, 1, 2).astype(np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([9, 9]), pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], names=["key", "rep", "sketch"])
    assert [x.to_pydict() for x in nd._lead(iter([batch]))] == [{"a": [1], "b": [2]}]


def test_shares_of_a_key_give_the_same(spark, monkeypatch):
    """Many near copies of one text under text ids, dealt out in shares of two."""
    rng = random.Random(8)
    base = prose(rng, 150).split()
    rows = [edited(rng, base, 0.01) for _ in range(40)] + [prose(rng, 60) for _ in range(10)]
    ids = [f"n{k:02d}" for k in range(50)]
    rng.shuffle(ids)
    df = spark.createDataFrame(list(zip([*ids, None], [*rows, rows[0]], strict=True)), "doc_id string, text string")
    want = brute_of_any(df.collect())
    monkeypatch.setattr(nd, "LED", 2)
    assert classes(df) == want and len({c for _, c in want}) < 30


def brute_of_any(rows):
    """``brute`` over places of the ids in their order."""
    from collections import namedtuple

    row = namedtuple("row", "doc_id text")
    order = sorted(r.doc_id for r in rows if r.doc_id is not None)
    back = dict(enumerate(order)) | {None: None}
    return sorted(((back[i], back[c]) for i, c in brute([row(None if r.doc_id is None else order.index(r.doc_id), r.text) for r in rows])), key=repr)


def test_links_of_every_text_of_an_id(spark):
    """Rows (1, A), (1, B), (2, near A), (3, near B) are one class: each text of an id keeps its links."""
    rng = random.Random(77)
    a, b, c = (prose(rng, 300) for _ in range(3))
    near = lambda t: " ".join(["other", *t.split()[1:]])
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (5, c), (6, near(c)), (6, "short text of its own"), (7, None), (7, near(c)), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.kept) for r in nd.near_groups(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True), (6, 5, False), (7, 5, False), (None, None, True)}
    assert nd.near_groups(df).count() == len(rows)
