import random
import re
import time

from pyspark.sql import functions as F

from lamplight.functions.text import trim_all
from lamplight.operators import chunks, store, vectors

SPACE = r"[\s ﻿]"


def scripted(s: str) -> str:
    """The five steps as a script takes them, with a backtracking search; line ends are \\n and \\r."""
    s = re.sub("  +", " ", s)
    start, end = r"(?:\A|(?<=[\n\r]))", r"(?=[\n\r]|\Z)"
    s = re.sub(rf"{start}{SPACE}+|{SPACE}+{end}", "", s)
    s = re.sub(r"([а-яё])\n([а-яё])", r"\1 \2", s)
    return re.sub(r"\n{3,}", "\n\n", s).strip(" \t\n\x0b\f\r ﻿")


def test_clean_scan_equals_the_script(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "б", " ", "\n", "\t", "\r", " ", "word"]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", "t", chunks.clean_scan(F.col("t")).alias("c")).collect()
    assert [(r.t, r.c) for r in rows if r.c != scripted(r.t)] == []


def test_long_runs_take_no_time(spark):
    texts = ["x" + "\t" * 1_000_000 + "y", "x" + "\n" * 1_000_000 + "y", "x" + " \n" * 500_000 + "y", "\t" * 1_000_000, "x" + "　" * 300_000 + "y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.limit(1).select(chunks.clean_scan(F.lit("a b"))).collect()
    began = time.perf_counter()
    got = [r[0] for r in df.select(F.char_length(chunks.clean_scan(F.col("t")))).collect()]
    assert time.perf_counter() - began < 20 and got[3] == 0
    assert df.select(F.max(F.char_length(trim_all(F.col("t"))))).first()[0] > 0


def test_bad_vectors_rank_nowhere(spark):
    nan = float("nan")
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 5.0]), (3, [nan, 1.0]), (4, [9.0]), (5, None), (6, [0.5, 0.5])], "id long, vector array<float>")
    qs = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [nan, 1.0])], "query_id long, query array<float>")
    assert [(r.query_id, r.id) for r in vectors.dense_scores(pts, qs, 5).orderBy("query_id", "rank").collect()] == [(0, 1), (0, 6)]
    assert vectors.dense_scores(pts, qs.limit(0), 5).count() == 0


def test_many_vectors_of_one_query_id(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_QUERIES", 3)
    pts = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "id long, vector array<float>")
    qs = spark.createDataFrame([(0, [float(k), 1.0]) for k in range(12)], "query_id long, query array<float>")
    assert {r.id for r in vectors.dense_scores(pts, qs, 1).collect()} <= {0, 1, 2, 3, 4}


def test_search_by_text_and_rewriting(spark):
    embed = vectors.hashing_embedder(16)
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green pear"), (3, "blue sky")], "id long, text string")
    points = vectors.embedded(docs, embed).select("id", F.col("dense").alias("vector"))
    asked = spark.createDataFrame([(7, "apple pie")], "query_id long, text string")
    got = vectors.search_texts(points, vectors.postings(docs, "id"), asked, embed).orderBy("rank").collect()
    assert got[0].id == 1 and got[0].query_id == 7
    assert [r.text for r in vectors.rewritten(docs, lambda ts: [t.upper() for t in ts]).orderBy("id").collect()] == ["RED APPLE PIE", "GREEN PEAR", "BLUE SKY"]
    assert vectors.rewritten(docs) is docs
    both = vectors.learned(docs, lambda ts: [{"dense": [1.0], "indices": [len(t)], "values": [0.5]} for t in ts])
    assert [(r.sparse_indices, r.sparse_values) for r in both.orderBy("id").collect()] == [([13], [0.5]), ([10], [0.5]), ([8], [0.5])]


def test_json_rows_and_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, [{"name": "a"}])], "id int, ingredients array<struct<name:string>>")
    assert store.json_row(rows).first().ingredients == '[{"name":"a"}]'
    table = store.create_table(spark, rows, str(tmp_path / "t"))
    assert table.count() == 0 and table.columns == rows.columns


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from lamplight import __main__ as cli

    body = "Возьмите: анис — 12 золотников (около 51,2 г).\n3 штофа (около 3,69 л) водки.\nИстолочь и настаивать две недели, потом перегнать и слить."
    (tmp_path / "book.txt").write_text(f"**12. Водка анисовая.**\n{body}", encoding="utf-8")
    (tmp_path / "short.txt").write_text("x", encoding="utf-8")
    assert cli.main(["--file", str(tmp_path), "--test", "--sql"]) == 0
    told = capsys.readouterr().out
    assert "left out: too short: x" in told and "left out in all: 1" in told and "12 Водка анисовая" in told and "recipe_number" in told
    assert cli.main(["--file", str(tmp_path), "--out", str(tmp_path / "out")]) == 0
    assert "'success': 1" in capsys.readouterr().out


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 50 and e.oracle_sql()"], cwd=root, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
