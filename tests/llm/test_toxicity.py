import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from awkward import documents, empty, prose
from lamplight.llm import toxicity as tx


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randint(30, 120)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["idiot", "moron", "scum", "stupid"]))
        rows.append(" ".join(w))
        labels.append((i, int(bad)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    rows = tx.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    assert right > 0.95
    assert not [r for r in held if r.predicted and not r.toxic]


def test_fold_and_columns(spark, corpus):
    import zlib

    docs, labels = corpus
    out = tx.toxicity(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    for r in out.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_labels_teach_nothing(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in tx.toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in tx.toxicity(docs, flipped).collect()}
    assert a == b


def test_awkward_rows(spark, corpus):
    labels = corpus[1]
    docs = documents(spark)
    assert tx.toxicity(docs, labels).count() == docs.count()
    assert tx.toxicity(empty(spark), labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in tx.toxicity(docs, none).collect()} == {0.5}
    odd = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert {r.score for r in tx.toxicity(docs, odd).collect()} == {0.5}
    one = labels.withColumn("toxic", F.lit(0))
    assert all(r.score < 0.5 for r in tx.toxicity(docs, one.unionByName(one)).collect())


def test_drop_keeps_columns(spark, corpus):
    docs, labels = corpus
    out = tx.drop_toxic(docs, labels)
    assert out.columns == docs.columns
    flagged = {r.doc_id for r in tx.toxicity(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in out.collect()} == set(range(600)) - flagged and out.first().score == "own score"


def test_model_is_a_distribution():
    """P(c | context) of each class sums to one over all characters, up to what the uniform floor leaves to unseen ones."""
    words = ["stupid", "stub", "the", "then", "them", "scum"]
    owner, g, h, low, lowh = tx.grams(words)
    uniq, at = np.unique(g, return_index=True)
    count = np.bincount(np.searchsorted(uniq, g))
    m = tx.estimate(uniq, h[at], low[at], lowh[at], count, np.zeros_like(count))
    assert np.isfinite(m.score(["the", "zebra", ""])).all()
    same = tx.estimate(uniq, h[at], low[at], lowh[at], count, count)
    assert np.allclose(same.score(words), 0, atol=1e-6)


def test_every_gram_has_a_ratio_of_its_own():
    """Far more n-grams than a table of 2^20 places holds: none shares its number, and what was not seen is not found."""
    rng = random.Random(7)
    words = list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(300_000)})
    _, g, h, low, lowh = tx.grams(words)
    uniq, at = np.unique(g, return_index=True)
    assert len(uniq) == len({("\x02" * 5 + w + "\x03")[k : k + 6] for w in words for k in range(len(w) + 1)}) > 1 << 20
    m = tx.estimate(uniq, h[at], low[at], lowh[at], np.ones(len(uniq), np.int64), np.zeros(len(uniq), np.int64))
    assert len(m.grams) == len(uniq)
    other = tx.grams(["ЖЖЖЖЖЖЖЖ", "0123456789"])[1]
    assert np.isnan(tx.found(m.grams, m.ratio, other, np.nan)).all()


def test_tables_grow_with_the_words(spark, corpus, monkeypatch):
    docs, labels = corpus
    whole = tx.train(docs, labels)[0]
    _, g, h, low, lowh = tx.grams(sorted({w for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for w in tx.WORD.findall(r.text.lower())}))
    assert set(whole.grams.tolist()) == set(g.tolist()) and set(whole.contexts.tolist()) == set(h.tolist())
    monkeypatch.setattr(tx, "RATED_GRAMS", 1)
    cut = tx.train(docs, labels)[0]
    assert (cut.grams == whole.grams).all() and (cut.ratio == whole.ratio).all() and (cut.unseen == whole.unseen).all()


def plain_ratios(texts, kinds):
    """Ratios of words and pairs by their definition, from lists of words and 0 or 1 for each."""
    from math import log

    def ratios(sets):
        n = {}
        for x, y in zip(sets, kinds, strict=True):
            for e in x:
                n.setdefault(e, [0, 0])[y] += 1
        total = [sum(v[y] for v in n.values()) for y in (0, 1)]
        left = sum(max(c - tx.DISCOUNT, 0) for v in n.values() for c in v)
        free = 1 - left / sum(total)
        out = {}
        for e, v in n.items():
            if max(v) > tx.DISCOUNT:
                p = [max(v[y] - tx.DISCOUNT, 0) / total[y] + free * sum(v) / sum(total) for y in (0, 1)]
                out[e] = log(p[1]) - log(p[0])
        return out

    words = ratios([set(t) for t in texts])
    return words, ratios([{p for p in zip(t, t[1:], strict=False) if p[0] in words and p[1] in words} for t in texts])


def test_expressions_equal_plain_ones(spark, corpus, monkeypatch):
    docs, labels = corpus
    monkeypatch.setattr(tx, "HELD_WORDS", 50)
    monkeypatch.setattr(tx, "HELD_PAIRS", 50)
    model = tx.train(docs, labels)[0]
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r.doc_id, tx.WORD.findall(r.text.lower())) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    words, pairs = plain_ratios([t for _, t in rows], [toxic[i] for i, _ in rows])
    assert len(words) > 100 and len(pairs) > 100
    assert dict(zip(model.words.tolist(), model.word_ratio.tolist(), strict=True)) == {k: np.float32(v) for k, v in zip(tx.numbers(list(words)).tolist(), words.values(), strict=True)}
    number = tx.pair_numbers(*(tx.numbers([p[k] for p in pairs]) for k in (0, 1))).tolist()
    assert np.allclose([dict(zip(model.pairs.tolist(), model.pair_ratio.tolist(), strict=True))[k] for k in number], list(pairs.values()), atol=1e-6) and len(model.pairs) == len(pairs)


def test_features_equal_plain_ones(spark, corpus):
    """A text's two features, word by word: pair over first word, else the word, else its characters."""
    docs, labels = corpus
    model = tx.train(docs, labels)[0]
    word = dict(zip(model.words.tolist(), model.word_ratio.tolist(), strict=True))
    pair = dict(zip(model.pairs.tolist(), model.pair_ratio.tolist(), strict=True))
    texts = [r.text for r in docs.limit(40).collect()] + ["", "idiot", "you stupid zebra, STUPID moron", "zzz qqq"]
    got = tx.features(texts, model, tx._cache(model))
    for t, g in zip(texts, got, strict=True):
        ws = tx.WORD.findall(t.lower())
        ns = tx.numbers(ws)
        r = []
        for k, w in enumerate(ws):
            n = int(ns[k])
            if n not in word:
                r.append(min(max(0.5 * float(model.score([w])[0]), -1), 1))
                continue
            both = int(tx.pair_numbers(ns[k - 1 : k], ns[k : k + 1])[0]) if k and int(ns[k - 1]) in word else None
            r.append(pair[both] - word[int(ns[k - 1])] if both in pair else word[n])
        top = sorted(r, reverse=True)[:3]
        want = (sum(top) / len(top), sum(max(x - 1, 0) for x in r) / len(r)) if r else (0, 0)
        assert np.allclose(g, want, atol=1e-4)


def test_tables_that_stay_in_spark(spark, corpus, monkeypatch):
    """Joins give every text the score that tables in the tasks give it: repeated, empty, null and wordless texts too."""
    docs, labels = corpus
    odd = documents(spark, ["", None, "...", "You STUPID moron", "zzz qqq", "you", "x" * 5000] * 2).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = docs.unionByName(odd)
    want = {r.doc_id: r for r in tx.toxicity(docs, labels).collect()}
    small = {r.doc_id for r in tx.drop_toxic(docs, labels).collect()}
    sizes = (0, tx.train(docs, labels)[0].pairs.size + 8)
    for most in sizes:  # no table is held, or only the one of pairs would be
        monkeypatch.setattr(tx, "HELD_RATIOS", most)
        assert isinstance(tx.train(docs, labels)[0], tx.Spread)
        got = tx.toxicity(docs, labels).collect()
        assert len(got) == len(want)
        for r in got:
            w = want[r.doc_id]
            assert abs(r.score - w.score) < 1e-6 and (r.held_out, r.predicted) == (w.held_out, w.predicted)
        kept = tx.drop_toxic(docs, labels)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == small


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_pairs_of_few_documents_that_stay_in_spark(spark, corpus, monkeypatch, most):
    """Whatever part of the pairs is sent, scores are the same, and few words are joined with the others."""
    docs, labels = corpus
    odd = documents(spark, ["", None, "...", "You STUPID moron", "zzz qqq", "you", "x" * 5000] * 2).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = docs.unionByName(odd)
    want = {r.doc_id: r for r in tx.toxicity(docs, labels).collect()}
    small = {r.doc_id for r in tx.drop_toxic(docs, labels).collect()}
    monkeypatch.setattr(tx, "HOT_PAIRS", most)
    made = []
    monkeypatch.setattr(tx, "written", lambda df, f=tx.written: made.append(f(df)) or made[-1])
    model, weights, _ = tx.train(docs, labels)
    assert isinstance(model, tx.Model if most == 10**6 else tx.Split)
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert abs(r.score - w.score) < 1e-9 and (r.held_out, r.predicted) == (w.held_out, w.predicted)
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == small
    if most == 40:
        handed = [df for df in made if "before" in df.columns]
        words = docs.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
        assert handed and all(df.agg(F.sum(F.size("pair"))).first()[0] < words / 2 for df in handed)


def test_pairs_of_the_most_documents_are_sent(spark, monkeypatch):
    rows = [(k, n, 0, 0, 0, *[None] * 4) for k, n in enumerate([3, 3, 4, 70, 70, 500, 9])] + [(None, *range(8))]
    two = spark.createDataFrame(rows, tx.KEPT)
    for most, want in ((0, set()), (2, {5}), (3, {3, 4, 5}), (4, {3, 4, 5, 6}), (6, {2, 3, 4, 5, 6}), (9, set(range(7)))):
        monkeypatch.setattr(tx, "HOT_PAIRS", most)
        hot, cold = ({r.key for r in x.collect()} for x in tx.parted(two))
        assert hot == want | {None} and cold == (set(range(7)) - want) | {None}


def test_pairs_are_handed_on_in_small_batches(monkeypatch):
    """Before, a task's counts of pairs were one batch, which Spark and the worker held whole."""
    monkeypatch.setattr(tx, "HANDED", 40, raising=False)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    vocabulary = np.sort(tx.numbers(words[:25]))
    lists = [[rng.choice(words) for _ in range(rng.choice((0, 1, 2, 60)))] for _ in range(80)]
    folds = [(rng.choice((0, 2)), rng.randint(0, 1)) for _ in lists]
    texts = pa.array([zstandard.compress(" ".join(x).encode()) for x in lists], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in folds]), pa.array([y for _, y in folds]), texts], names=["part", "y", "z"])
    run = tx._pairs(SimpleNamespace(value=vocabulary))
    out = list(run(iter([batch])))
    assert len(out) > 2 and max(b.num_rows for b in out) <= 40
    want = Counter()
    for x, kind in zip(lists, folds, strict=True):
        for a, b in {(a, b) for a, b in zip(x, x[1:]) if a in words[:25] and b in words[:25]}:
            want[int(tx.pair_numbers(tx.numbers([a]), tx.numbers([b]))[0]), tx.NUMBER[kind]] += 1
    rows = [r for b in out for r in b.to_pylist()]
    assert len({r["g"] for r in rows}) == len(rows)
    assert Counter({(r["g"], k): n for r in rows for k, c in enumerate(tx.FOUR) if (n := r[c])}) == want
    assert list(run(iter([batch.slice(0, 0)]))) == [] == list(run(iter([batch.take([k for k, x in enumerate(lists) if len(x) < 2])])))
