"""Substring searches by postings give what a scan gives."""

import random

import pytest
from pyspark.sql import functions as F

from lamplight.streaming import grams, parts

ROWS = [(1, "Корица и Имбирь"), (2, "brand#13 100%"), (3, "BRAND#131 and a_b"), (4, None), (5, ""), (6, "ab"), (7, "İstanbul ΟΔΟΣ"), (8, "back\\slash"), (None, "brand#13 of no key"), (9, "\U0001f600\U0001f601\U0001f602 smile"), (10, "x" * 50_000 + "needle")]
TERMS = ["brand#13", "BRAND#13", "корица", "ab", "", "a", "100\\%", "brand%100", "a_b", "b_d#13", "%%", "needle", "no such words", "\U0001f600\U0001f601\U0001f602", "οδος", "istan", "ck\\\\sl", "d#131 and a\\_b"]


def put(spark, path, rows, at, name=None, n=4):
    df = spark.createDataFrame([(k, v, at) for k, v in rows], "k long, v string, at long")
    return parts.upsert_parts(spark, path, df, ["k"], [F.col("at")], name, n, indexed="v")


def held(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=repr)


@pytest.mark.parametrize("literal", [False, True])
def test_equals_scan(spark, tmp_path, literal):
    path = f"{tmp_path}/t"
    assert grams.rows_with(spark, path, "any") is None
    put(spark, path, ROWS, 1)
    every = parts.read_parts(spark, path)
    for term in TERMS:
        assert held(grams.rows_with(spark, path, term, literal)) == held(every.where(grams.like(every, "v", term, literal))), term


def test_upserts_keep_postings(spark, tmp_path):
    """A row that changes its text is found by the new one alone, in earlier commits by the old; clearing takes postings along."""
    rng = random.Random(4)
    path, state = f"{tmp_path}/t", {}
    for b in range(4):
        rows = [(rng.randrange(60), "".join(rng.choice("abc ") for _ in range(12))) for _ in range(30)]
        rows = list(dict(rows).items())
        put(spark, path, rows, b, f"b{b}")
        state |= dict(rows)
        term = rng.choice(list(state.values()))[2:6]
        assert held(grams.rows_with(spark, path, term, True)) == sorted(((k, v) for k, v in state.items() if term in v), key=repr)
    early = parts.read_parts(spark, path, 0).where(F.contains("v", F.lit("ab")))
    assert held(grams.rows_with(spark, path, "ab", True, 0)) == held(early)
    put(spark, path, [(1, "changed text")], 9)
    parts.clear(spark, path, 1)
    live = set(parts.manifest(spark, path)["parts"].values())
    assert {str(x.relative_to(tmp_path / "t")).replace("grams/", "parts/") for x in (tmp_path / "t" / "grams").glob("part=*/by=*")} <= live
    assert held(grams.rows_with(spark, path, "hanged t")) == [(1, "changed text")]


def test_reads_matching_parts_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, [(k, f"row number {k:05d}") for k in range(2000)], 1, n=32)
    found = grams.rows_with(spark, path, "00777")
    assert held(found) == [(777, "row number 00777")]
    assert len({f.split("/part=")[1].split("/")[0] for f in found.inputFiles() if "/parts/" in f}) <= 2
    assert grams.rows_with(spark, path, "99999").count() == 0


def test_nested_columns_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [("Brand#13", 2.0)]), (2, None), (3, [])], "k long, v array<struct<name:string,amount:double>>").withColumn("gram", F.lit(1)).withColumn("text", F.lit("t"))
    parts.upsert_parts(spark, f"{tmp_path}/t", df, ["k"], [F.col("k")], indexed="v", parts=2)
    assert [r.k for r in grams.rows_with(spark, f"{tmp_path}/t", '"name":"brand#13","am').collect()] == [1]
    parts.upsert_parts(spark, f"{tmp_path}/e", df.limit(0), ["k"], [F.col("k")], indexed="v")
    assert grams.rows_with(spark, f"{tmp_path}/e", "brand").count() == 0


def test_postings_are_lists(spark, tmp_path):
    """A gram of a batch is one row, however many rows have it; of what most rows have the keys are not kept. Before, each row of a gram was one of its own."""
    path = f"{tmp_path}/t"
    put(spark, path, [(k, f"row number {k:05d}" + (" odd" if k % 2 else "") + (" rare" if k % 400 == 7 else "")) for k in range(2000)], 1, n=2)
    m = parts.manifest(spark, path)
    held = spark.read.parquet(*[f"{path}/{d}" for d in m["grams"].values()])
    assert held.count() < 2000 and held.where("k is null").count() >= 2 * len("row number 0") - 4
    assert held.agg(F.max(F.size("k"))).first()[0] <= 1000
    for term in ("number", "odd", "rare", "0 odd", "0%odd rare", "r 01%7 r", "row 1", "number 00777", "numbers"):
        got = grams.rows_with(spark, path, term)
        every = parts.read_parts(spark, path)
        assert sorted(r.k for r in got.collect()) == sorted(r.k for r in every.where(grams.like(every, "v", term)).collect()), term


def test_postings_equal_plain_ones():
    """Few letters and so many that a gram and a place exceed one number; texts of no gram, or none at all."""
    rng = random.Random(3)
    few = ["".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(0, 9))) for _ in range(50)] + ["", "aa"]
    for texts in (few, [], [""], ["ab"], ["abc"], few * 3):
        check_posted(texts)
    wide = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x60000)]))
    texts = [wide, *(wide[k : k + 3] for k in range(300))]
    assert len(wide) ** 3 * len(texts) > 1 << 63
    check_posted(texts)


def check_posted(texts):
    want = {}
    for k, t in enumerate(texts):
        for g in {t[i : i + 3] for i in range(len(t) - 2)}:
            want.setdefault((ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2]), []).append(k)
    gram, counts, owner = grams.posted(texts)
    assert gram.tolist() == sorted(want) and counts.tolist() == [len(want[g]) for g in sorted(want)]
    assert owner.tolist() == [k for g in sorted(want) for k in want[g]]
