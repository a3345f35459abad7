import os
import random
import re
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(__file__))
import numpy as np
import pytest
from pyspark.sql import functions as F

from awkward import documents, empty
from lamplight.llm import divergence as dv


def brute(rows, least=10):
    counts, held = defaultdict(Counter), Counter()
    for lang, source, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        counts[lang or "", source or ""].update(terms)
        held.update((lang or "", t) for t in set(terms))
    out = []
    for lang in {k[0] for k in counts}:
        kept = sorted(t for (x, t), n in held.items() if x == lang and n >= least)
        groups = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}
        share = lambda g: {t: 1 + 10**9 * (g[t] + 2) // (sum(g.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(g) for s, g in groups.items()}, share(whole)
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            terms = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, name, -v, k) for k, (v, _, name) in enumerate(found, 1)]
    return sorted(out)


def rows_of(docs):
    return [(r.lang, r.source, r.text) for r in docs.collect()]


def divergence_of(docs, **how):
    out = dv.source_divergence(docs, **how)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


def sources(seed, n, groups):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "été", "漢字", "x1y", "delta", "eps", "zeta", "eta's"]
    rows = []
    for k in range(n):
        g = rng.randrange(groups)
        rows.append((k, " ".join(rng.choice(words[: 3 + g % 8]) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de"]), f"s{g}"))
    return rows


@pytest.mark.parametrize("groups, team, stretch", [(1, 8, 65536), (2, 8, 65536), (7, 2, 3), (9, 1, 2), (6, 4, 65536)])
def test_equals_brute_force(spark, groups, team, stretch):
    docs = spark.createDataFrame(sources(groups, 150, groups), "doc_id long, text string, lang string, source string")
    want = brute(rows_of(docs), 3)
    assert bool(want) == (groups > 1) and divergence_of(docs, least=3, team=team, stretch=stretch) == want


def test_awkward_tables(spark):
    docs = documents(spark)
    assert divergence_of(docs, least=2) == brute(rows_of(docs), 2)
    assert divergence_of(docs) == brute(rows_of(docs))
    assert dv.source_divergence(empty(spark)).count() == 0


def test_languages_without_terms_keep_their_pairs(spark):
    docs = documents(spark, ["12 34", None, "", "x"])
    got = divergence_of(docs)
    assert got == brute(rows_of(docs)) and all(r[2] == "pair" and r[4] == 0 for r in got) and got


def test_many_small_tables_of_a_task(spark, monkeypatch):
    """Counts that a task hands on early add up to the same."""
    docs = spark.createDataFrame(sources(5, 200, 5), "doc_id long, text string, lang string, source string").repartition(3)

    def early(batches):
        from lamplight.llm import divergence

        before, divergence.HELD = divergence.HELD, 10
        try:
            yield from divergence._count(batches)
        finally:
            divergence.HELD = before

    monkeypatch.setattr(dv, "_count", early)
    assert divergence_of(docs, least=3) == brute(rows_of(docs), 3)


@pytest.mark.parametrize("teams", [1, 2, 3, 4, 7, 10])
def test_tournament(spark, teams):
    """Each two teams meet once, none twice in a round, and seats get visitors in turn."""
    df = spark.range(teams).select(F.col("id").cast("int").alias("own"), F.explode(dv.visits(F.col("id").cast("int"), F.lit(teams))).alias("v"))
    met = [(r.own, r.v.seat, r.v.round) for r in df.collect()]
    assert sorted(tuple(sorted(m[:2])) for m in met) == [(a, b) for a in range(teams) for b in range(a + 1, teams)]
    for r in {m[2] for m in met}:
        there = [x for m in met if m[2] == r for x in m[:2]]
        assert len(there) == len(set(there))
    hosted = Counter(m[1] for m in met)
    assert max((hosted[t] for t in range(teams))) - min(hosted[t] for t in range(teams)) <= 1


def test_shares_are_exact():
    rng = random.Random(1)
    for total in (1, 7, 10**6, 10**12, (1 << 48) - 1, 1 << 48, 10**16):
        counts = [min(total - 1, c) for c in (0, 1, rng.randrange(total), total - 2 if total > 2 else 0)]
        assert dv.shares(np.array(counts, np.int64), total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts] or total == 1
