"""Upserts that rewrite only what a batch touches."""

import os

import pytest
from pyspark.sql import functions as F

from lamplight.streaming import parts


def rows_of(df):
    return sorted((r.k, r.v, r.at) for r in df.collect())


def put(spark, path, rows, name=None, n=16):
    return parts.upsert_parts(spark, path, spark.createDataFrame(rows, "k long, v string, at long"), ["k"], [F.col("at")], name, n)


def test_state_equals_latest_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert parts.read_parts(spark, path) is None
    want = {}
    for b, rows in enumerate(([(k, f"a{k}", 1) for k in range(50)], [(3, "b3", 2), (3, "b3x", 1), (77, "b77", 1)], [], [(3, "c3", 0), (4, "c4", 9)])):
        put(spark, path, rows, f"batch-{b}")
        for k, v, at in sorted(rows, key=lambda r: r[2]):
            want[k] = (k, v, at)
        assert rows_of(parts.read_parts(spark, path).drop("part")) == sorted(want.values())
    assert [parts.manifest(spark, path, k)["wrote"] for k in parts.commits(spark, path)][1:] == [2, 0, 2]
    # earlier states stay readable
    assert dict((r.k, r.v) for r in parts.read_parts(spark, path, 1).collect())[3] == "b3"


def test_a_small_batch_rewrites_few_parts(spark, tmp_path):
    """Ten keys into 10^6 rewrite ten parts at most; all other files are the same ones."""
    path = f"{tmp_path}/t"
    many = spark.range(1_000_000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).cast("long").alias("at"))
    first = parts.upsert_parts(spark, path, many, ["k"], [F.col("at")], parts=64)
    second = put(spark, path, [(k * 99_991, "new", 2) for k in range(10)])
    changed = [k for k in second["parts"] if second["parts"][k] != first["parts"][k]]
    assert 1 <= len(changed) == second["wrote"] <= 10
    files = lambda d: [f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")]
    assert all(len(files(d)) == 1 for d in second["parts"].values())
    now = parts.read_parts(spark, path)
    assert now.count() == 1_000_000 and now.where("v = 'new'").count() == 10
    # rows of one part are read from its directory alone
    assert len(now.where("part = 5").inputFiles()) == 64 and now.where("part = 5").count() > 0


def test_replay_does_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, [(1, "a", 1)], "q-0")
    once = put(spark, path, [(1, "b", 2)], "q-1")
    assert put(spark, path, [(1, "never", 9)], "q-1") == once and len(parts.commits(spark, path)) == 2
    assert rows_of(parts.read_parts(spark, path).drop("part")) == [(1, "b", 2)]


def test_failure_before_the_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    put(spark, path, [(k, "a", 1) for k in range(20)], "q-0")

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(parts, "_commit", broken)
        with pytest.raises(OSError):
            put(spark, path, [(2, "b", 2)], "q-1")
    assert rows_of(parts.read_parts(spark, path).drop("part")) == [(k, "a", 1) for k in range(20)]
    put(spark, path, [(2, "b", 2)], "q-1")
    assert (2, "b", 2) in rows_of(parts.read_parts(spark, path).drop("part"))
    assert parts.read_parts(spark, path).count() == 20


def test_two_writers_of_one_commit(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, [(1, "a", 1)])
    now = parts.manifest(spark, path)
    with pytest.raises(parts.Conflict):
        parts._commit(spark, path, 0, now | {"parts": {}})
    assert parts.read_parts(spark, path).count() == 1 and not [f for f in os.listdir(f"{path}/commits") if f.startswith(".0-") and not f.endswith(".crc")]


def test_clear_keeps_what_the_last_commits_name(spark, tmp_path):
    path = f"{tmp_path}/t"
    for b in range(4):
        put(spark, path, [(1, f"v{b}", b), (100 + b, "x", b)])
    before = rows_of(parts.read_parts(spark, path).drop("part"))
    held = {d for k in (2, 3) for d in parts.manifest(spark, path, k)["parts"].values()}
    assert parts.clear(spark, path) > 0 and parts.commits(spark, path) == [2, 3]
    there = {f"parts/{p}/{d}" for p in os.listdir(f"{path}/parts") if p.startswith("part=") for d in os.listdir(f"{path}/parts/{p}") if d.startswith("by=")}
    assert there == held and rows_of(parts.read_parts(spark, path).drop("part")) == before
    assert parts.clear(spark, path) == 0


def test_columns_that_come_later(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, [(1, "a", 1), (2, "b", 1)])
    more = spark.createDataFrame([(2, "c", 2, 7)], "k long, v string, at long, n int")
    parts.upsert_parts(spark, path, more, ["k"], [F.col("at")])
    assert sorted((r.k, r.v, r.n) for r in parts.read_parts(spark, path).collect()) == [(1, "a", None), (2, "c", 7)]
