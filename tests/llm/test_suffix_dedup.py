import hashlib
import random

import numpy as np
import pytest

from awkward import documents, empty, prose, texts
from lamplight.llm import suffix_dedup as sd


def brute(rows):
    owner = {}
    for r in rows:
        b = (r.text or "").encode()
        if r.doc_id is not None:
            for s in range(len(b) - 49):
                k = b[s : s + 50]
                owner[k] = min(owner.get(k, r.doc_id), r.doc_id)
    out = []
    for r in rows:
        b = (r.text or "").encode()
        gone = np.zeros(len(b), bool)
        if r.doc_id is not None:
            for s in range(len(b) - 49):
                if owner[b[s : s + 50]] < r.doc_id:
                    gone[s : s + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((r.doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def check(df):
    assert sorted(map(tuple, sd.remove_repeats(df).collect()), key=repr) == brute(df.collect())


def test_awkward(spark):
    check(documents(spark))
    assert sd.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, 40) for _ in range(5)] + ["ab" * 60, "x" * 120, "Der " * 40]
    rows = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            i = rng.randint(0, len(p) - 1)
            parts.append(rng.choice([prose(rng, 5), p[i : i + rng.randint(30, 160)]]))
        rows.append(rng.choice(["", " ", "|"]).join(parts))
    ids = list(range(60))
    rng.shuffle(ids)
    check(documents(spark, rows, ids=ids))


def test_lengths_around_the_limit(spark):
    rng = random.Random(9)
    p = prose(rng, 40)
    check(documents(spark, [p[:200]] + [f"{k:03d}" + p[60 : 60 + k] + f"#{k}" for k in range(40, 70)]))


def test_rows_of_one_id(spark):
    a, b = texts()[0] + texts()[1], texts()[2] + texts()[1]
    check(documents(spark, [a, b, b, a, a + b], ids=[5, 5, 5, 7, 7]))


def test_small_pieces_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(sd, "PARSED", 500)
    monkeypatch.setattr(sd, "SORTED", 3)
    check(documents(spark))


def test_every_string_holds_a_trigger():
    rng = np.random.default_rng(1)
    b = rng.integers(97, 101, 3000, dtype=np.uint8)
    at, _, _ = sd.triggers(b, np.array([0, 1000]), np.array([1000, 2000]))
    for s in [*range(0, 951), *range(1000, 2951)]:
        assert ((at >= s) & (at <= s + sd.LENGTH - sd.GRAM)).any()


def test_hot_triggers_give_the_same(spark, monkeypatch):
    """A passage in most documents, each with surroundings of its own: by phrase, by digest and in one task."""
    rng = random.Random(4)
    passage = prose(rng, 25)
    rows = [f"{prose(rng, 15)} {passage} {prose(rng, 15)}" for _ in range(60)] + [passage, passage[20:90], prose(rng, 60)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    docs = documents(spark, rows, ids=ids)
    check(docs)
    monkeypatch.setattr(sd, "SORTED", 5)
    check(docs)
    monkeypatch.setattr(sd, "SETTLED", 40)
    check(docs)
    monkeypatch.setattr(sd, "SAMPLED", 1)
    monkeypatch.setattr(sd, "SEEN", 1)
    known = docs.selectExpr("doc_id id", "cast(text as binary) text")
    assert len(sd.hot_triggers(known, 4)) > 0
    check(docs)


def test_ids_of_other_types(spark):
    rows = [r for r in texts() if r][:30] * 2
    ids = [f"d{k:03d}" for k in range(60)]
    random.Random(2).shuffle(ids)
    df = spark.createDataFrame(list(zip([*ids, None], [*rows, rows[0]], strict=True)), "doc_id string, text string")
    check(df)


def test_orders_tell_the_bytes_that_neighbours_share():
    rng = random.Random(1)
    some = [bytes(rng.choices(b"ab\x00", k=rng.randint(0, 6))) for _ in range(200)]
    rank, shared = sd._order(some, 6)
    distinct = sorted(set(some))
    assert [distinct[k] for k in rank] == some
    assert shared[1:].tolist() == [len(__import__("os").path.commonprefix([a, b])) for a, b in zip(distinct, distinct[1:], strict=False)]


@pytest.mark.parametrize("window", [1, 37, 1000])
def test_windows_show_what_the_whole_shows(monkeypatch, window):
    rng = np.random.default_rng(window)
    for most, letters in ((5, 2), (60, 4), (300, 2), (900, 250)):
        sizes = rng.integers(0, most, 12)
        text = rng.integers(0, letters, int(sizes.sum())).astype(np.uint8)
        want = sd._triggers(text, np.cumsum(sizes) - sizes, sizes)
        monkeypatch.setattr(sd, "WINDOW", window)
        got = sd.triggers(text, np.cumsum(sizes) - sizes, sizes)
        assert all(a.tolist() == b.tolist() for a, b in zip(want, got, strict=True))


def rows_made(df, node: str) -> int:
    """Rows that the named step of a plan has made, once its rows are collected."""
    df.collect()
    total, seen = 0, [df._jdf.queryExecution().executedPlan()]
    while seen:
        plan = seen.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            seen.append(plan.executedPlan())
            continue
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            seen.append(plan.plan())
            continue
        if plan.simpleString(100).startswith(node):
            total += plan.metrics().apply("pythonNumRowsReceived").value()
        below = plan.children()
        seen += [below.apply(k) for k in range(below.size())]
    return total


def test_strings_of_hot_triggers_are_packed_by_document(spark, monkeypatch):
    """Before, each task that had met strings of a document made a row for it."""
    rng = random.Random(8)
    passage = prose(rng, 120)
    rows = [f"{prose(rng, 3)}{passage[k : k + 600]}{prose(rng, 3)}" for k in range(40)]
    docs = documents(spark, rows, extra=False)
    monkeypatch.setattr(sd, "SAMPLED", 1)
    monkeypatch.setattr(sd, "SEEN", 1)
    monkeypatch.setattr(sd, "SORTED", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sd.remove_repeats(docs)
        assert 0 < rows_made(out, "MapInArrow _packed") <= len(rows)
        check(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
