"""The fuzzy id join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamplight.operators import matching


def alike(a, b):
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))


def brute(records, texts):
    """Best text of each record: {record: position}; equal ids are left to the caller."""
    out = {}
    for r in records:
        inside = [(-min(len(r), len(t)), k) for k, t in enumerate(texts) if t in r or r in t]
        near = [] if inside else [(-s, k) for k, t in enumerate(texts) if (s := alike(t, r)) > 0.8]
        if inside or near:
            out[r] = min(inside or near)[1]
    return out


def ids_of(rng, n, words):
    out = set()
    while len(out) < n:
        s = "_".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice(["", "_", str(rng.randint(1, 400))])
        if rng.random() < 0.3:  # one or two places changed
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(s))
                s = s[:k] + rng.choice("abcxyz") + s[k + 1 :]
        out.add(s)
    return sorted(out)


def matched(spark, records, texts):
    probe = spark.createDataFrame([(r,) for r in records], "__r string")
    ids = spark.createDataFrame(list(zip(texts, range(len(texts)))), "t_id string, t_pos int")
    place = {t: k for k, t in enumerate(texts)}
    return {r["__q"]: place[r.t_id] for r in matching.best_matches(probe, ids).collect()}


@pytest.mark.parametrize("seed, hot", [(1, 1000), (2, 3), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(matching, "HOT", hot)
    rng = random.Random(seed)
    words = ["anis", "mint", "recipe", "vodka", "ёлка", "a", "of", "q7", "x" * 30, "настойка_на_травах"]
    both = ids_of(rng, 500, words)
    rng.shuffle(both)
    records, texts = both[:250], both[250:]
    want = brute(records, texts)
    assert 100 < len(want) and matched(spark, records, texts) == want


def test_lengths_around_the_threshold(spark):
    """Texts of every length with one place too few and one too many that differ."""
    rng = random.Random(5)
    records, texts = [], []
    for n in range(1, 90):
        s = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        most = (n - 1) // 5
        for d in {most, most + 1} & set(range(1, n)):
            t = list(s)
            for k in rng.sample(range(n), d):
                t[k] = t[k].upper()
            texts.append("".join(t))
        if most:
            texts.append(s[: n - most].upper()[:1] + s[1 : n - most + 1])  # shorter, and the first place differs
        records.append(s)
    texts = sorted(set(texts) - set(records))
    assert matched(spark, records, texts) == brute(records, texts)


def test_no_product_in_the_plan(spark, capsys):
    probe = spark.createDataFrame([("abcdefg",)], "__r string")
    ids = spark.createDataFrame([("abcdefgh", 1)], "t_id string, t_pos int")
    matching.best_matches(probe, ids).explain("formatted")
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_work_grows_below_the_product(spark):
    """10^4 ids against 10^4: candidates that are checked are a small share of 10^8 pairs; answers equal brute force."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    base = ["recipe_" + "".join(rng.choice(letters) for _ in range(rng.randint(6, 14))) for _ in range(20_000)]
    texts = sorted(set(base[:10_000]))
    records = sorted({t[:9] + rng.choice("ABC") + t[10:] for t in texts[::20]} | set(base[10_000:]) - set(texts))
    left = spark.createDataFrame([(r,) for r in records], "l string")
    right = spark.createDataFrame([(t,) for t in texts], "r string")
    n = F.char_length("l")
    keyed = left.withColumn("size", F.explode(F.sequence(n, F.floor((5 * n - 1) / 4).cast("int")))).select(F.explode(matching.block_keys(F.col("l"), F.col("size"))).alias("key"))
    mine = right.withColumn("size", F.char_length("r")).select(F.explode(matching.block_keys(F.col("r"), F.col("size"))).alias("key"))
    checked = keyed.join(mine, "key").count()
    assert checked < len(records) * len(texts) / 20
    assert matched(spark, records, texts) == by_arrays(records, texts)


def by_arrays(records, texts):
    """Brute force for many ids: containment by all substrings, similarity by arrays of all pairs."""
    place = {t: k for k, t in enumerate(texts)}
    parts = lambda s: {s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    best = {}
    asked = set(records)
    for t, k in place.items():
        for r in parts(t) & asked:
            best[r] = min(best.get(r, (0, 0)), (-len(r), k))
    for r in records:
        for t in parts(r) & set(place):
            best[r] = min(best.get(r, (0, 0)), (-len(t), place[t]))
    rest = [r for r in records if r not in best]
    width = max(map(len, [*rest, *texts]))
    grid = np.array([list(t.ljust(width, "\0")) for t in texts]).view(np.uint32).reshape(len(texts), width)
    sizes = np.array([len(t) for t in texts])
    for r in rest:
        same = sum((grid[:, k] == ord(c)).astype(np.int16) for k, c in enumerate(r))
        similar = same / np.maximum(sizes, len(r))
        if similar.max() > 0.8:
            best[r] = (-similar.max(), int(similar.argmax()))
    return {r: k for r, (_, k) in best.items()}
