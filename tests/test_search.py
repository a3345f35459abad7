from pyspark.sql import functions as F

from lamplight.operators import matching, vectors
from lamplight.operators.store import sparse_flags


def test_fusion(spark):
    dense = spark.createDataFrame([(0, i, k) for k, i in enumerate([1, 2, 3], 1)], "query_id long, id long, rank int")
    sparse = spark.createDataFrame([(0, i, k) for k, i in enumerate([2, 4], 1)], "query_id long, id long, rank int")
    got = [(r.id, round(r.score, 6)) for r in vectors.fuse(dense, sparse).orderBy("rank").collect()]
    assert got == [(2, 0.032522), (1, 0.016393), (4, 0.016129), (3, 0.015873)]
    assert got == [(r.id, round(r.score, 6)) for r in vectors.fuse(sparse, dense).orderBy("rank").collect()]


def test_dense_batch_equals_single(spark):
    pts = spark.createDataFrame([(k, [float(k % 3), float(k % 5), 1.0]) for k in range(50)] + [(99, None)], "id long, vector array<float>")
    qs = spark.createDataFrame([(k, [1.0, float(k), 0.5]) for k in range(4)], "query_id long, query array<float>")
    every = {(r.query_id, r.rank): r.id for r in vectors.dense_scores(pts, qs, 5).collect()}
    for k in range(4):
        assert {r.rank: r.id for r in vectors.dense_scores(pts, qs.where(F.col("query_id") == k), 5).collect()} == {r: i for (q, r), i in every.items() if q == k}
    by_expression = pts.where("vector is not null").crossJoin(F.broadcast(qs)).withColumn("score", vectors.dot(F.col("vector"), F.col("query")))
    assert {(r.query_id, r.rank): r.id for r in vectors.ranked(by_expression, 5).collect()} == every


def test_vocabulary(spark):
    df = spark.createDataFrame([("корица корица", "Имбирь"), ("пусто", None)], "content string, name string")
    v = vectors.vocabulary_vectors(df, {"spices_herbs": ["корица", "ир"], "techniques": ["настаивать"]}, F.col("content"), F.col("name"))
    rows = sparse_flags(v).collect()
    assert rows[0].sparse == {"spices_herbs": {0: 4.0, 1: 2.0}}
    assert rows[0].has_spices_herbs and not rows[0].has_techniques and rows[1].sparse == {}


def match(spark, rec, texts):
    r = spark.createDataFrame([(rec, "N", "C")], "id string, name string, category string")
    t = spark.createDataFrame([(i, f"text {i}", k) for k, i in enumerate(texts)], "id string, full_text string, pos int")
    x = matching.match_texts(r, t).first()
    return x.full_text, x.text_found


def test_matching(spark):
    assert match(spark, "анис_1", ["anis_10", "anis_1"]) == ("text anis_1", True)
    assert match(spark, "anis", ["q", "anis_voda"]) == ("text anis_voda", True)
    assert match(spark, "kefir", ["vodka_x"]) == ("N C", False)
    assert match(spark, "nation_12_x", ["nation_1", "nation_12"]) == ("text nation_12", True)
    assert match(spark, None, ["a", "", None]) == ("N C", False)


def test_matching_grid_equals_broadcast(spark, monkeypatch):
    recs = spark.createDataFrame([(f"id_{k}_{'x' * (k % 3)}", "N", "C") for k in range(30)], "id string, name string, category string")
    texts = spark.createDataFrame([(f"id_{k}", f"t{k}", k) for k in range(40)], "id string, full_text string, pos int")
    want = sorted((r.id, r.full_text) for r in matching.match_texts(recs, texts).collect())
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 200)
    assert sorted((r.id, r.full_text) for r in matching.match_texts(recs, texts).collect()) == want


def test_embedder(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    rows = vectors.embedded(df, vectors.hashing_embedder(8)).collect()
    assert abs(sum(x * x for x in rows[0].dense) - 1) < 1e-6 and set(rows[1].dense) == {0.0}


def test_every_row_divisible_by_20_is_a_query(spark, tmp_path):
    from lamplight.plans.registry import QUERIES

    spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(90)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k, f"w{'abcd'[k % 4]} all") for k in range(130)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = lambda name: {r.query_id for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert asked("dense_topk_every") == set(range(0, 90, 20))
    assert asked("sparse_topk_every") == asked("hybrid_rrf_every") == set(range(0, 130, 20))


def test_sparse_passes_equal_one(spark, monkeypatch):
    tokens = spark.createDataFrame([(k, f"t{j}") for k in range(30) for j in range(8) if (k * 7 + j) % 3], "id long, token string")
    queries = tokens.where("id % 2 = 0").withColumnRenamed("id", "query_id")
    rows = lambda: sorted(map(tuple, vectors.sparse_scores(tokens, queries, 5).collect()))
    want = rows()
    taken = []
    monkeypatch.setattr(vectors, "MOST_QUERIES", 4)
    monkeypatch.setattr(vectors, "ranked", lambda scores, top, f=vectors.ranked: (taken.append(1), f(scores, top))[1])
    assert rows() == want and len(taken) > 1
