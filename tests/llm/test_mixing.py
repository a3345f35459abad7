import hashlib
import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from awkward import documents, empty, prose
from lamplight.llm import mixing as mx


def sources(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["big"] * 8 + ["mid"] * 3 + ["small", None]), 0) for i in range(n)]
    rows += [(n + k, "", "en", "blank", 0) for k in range(3)] + [rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("block", F.lit("own"))


def brute(rows, limit=1.5):
    tokens = [len([w for w in (r.text or "").split(" ") if w]) for r in rows]
    have, docs = defaultdict(int), defaultdict(list)
    for r, t in zip(rows, tokens, strict=True):
        have[r.source] += t
        docs[r.source].append((hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest(), r.doc_id, t))
    live = [h for h in have.values() if h]
    ratio = max(live) / min(live)
    tau = max(0.0, 1 - math.log(limit) / math.log(ratio)) if ratio > 1 else 0.0
    total = sum(live)
    z = sum((h / total) ** tau for h in live)
    budget = int(total * z * (max(live) / total) ** (1 - tau) + 0.5)
    blocks = max(1, -(-len(rows) // mx.BLOCK_DOCS))
    out = []
    for s, items in docs.items():
        quota = int((have[s] / total) ** tau / z * budget + 0.5) if have[s] else 0
        epochs, rest = divmod(quota, have[s]) if have[s] else (1, 0)
        run = 0
        for o, i, t in sorted(items, key=lambda x: (int(x[0][:8], 16) % blocks, x)):
            run += t
            n = epochs + (rest > 0 and run <= rest)
            out += [(i, s, t, int(o[:8], 16) % blocks, e) for e in range(n)]
    return sorted(out, key=repr)


def test_equals_brute_force(spark, monkeypatch):
    df = sources(spark)
    assert sorted(map(tuple, mx.mix(df).collect()), key=repr) == brute(df.collect())
    monkeypatch.setattr(mx, "BLOCK_DOCS", 17)
    assert sorted(map(tuple, mx.mix(df).collect()), key=repr) == brute(df.collect())


def test_sources_that_are_not_broadcast(spark, monkeypatch):
    df = sources(spark)
    want = sorted(map(tuple, mx.mix(df).collect()), key=repr)
    monkeypatch.setattr(mx, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mx.mix(df).collect()), key=repr) == want


def test_no_document_is_lost_and_none_repeats_too_often(spark):
    df = sources(spark)
    drawn = mx.mix(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("epoch").alias("e")).collect()
    assert len(drawn) == df.select("doc_id").distinct().count()
    assert max(r.e for r in drawn) <= 1


def test_entropy_target(spark):
    df = sources(spark)
    shares = df.withColumn("t", mx.words(F.col("text"))).groupBy("source").agg(F.sum("t").alias("tokens")).cache()
    q = [r.tokens for r in shares.collect() if r.tokens]
    natural = -sum(x / sum(q) * math.log(x / sum(q)) for x in q)
    goal = (natural + math.log(len(q))) / 2
    tau = mx.exponent(shares, None, goal)
    p = [x**tau for x in q]
    got = -sum(x / sum(p) * math.log(x / sum(p)) for x in p)
    assert abs(got - goal) < 1e-6 and 0 < tau < 1


def test_budget_is_kept(spark):
    df = sources(spark)
    out = mx.mix(df, budget=1000)
    assert out.agg(F.sum("tokens")).first()[0] <= 1000 + 5


def test_awkward(spark):
    docs = documents(spark)
    out = mx.mixed_rows(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert mx.mix(empty(spark)).count() == 0
    assert mx.mix(documents(spark, ["", None, " "])).count() == 3
