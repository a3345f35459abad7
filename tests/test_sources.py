import json

from pyspark.sql import functions as F

from lamplight.sources import readers
from lamplight.streaming import ingest


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("один\nдва", encoding="utf-8")
    r = readers.read_texts(spark, str(tmp_path)).first()
    assert r.text == "один\nдва" and r.meta["path"].endswith("a.txt")


def test_structured(spark, tmp_path):
    rec = {"id": "a", "name": "n", "ingredients": ["x", "y"], "infusion_ingredients": None, "process": ["p"]}
    (tmp_path / "r.json").write_text(json.dumps({"data": {"recipes": [rec, {"id": "b"}], "recipes_full_text": [{"id": "a", "full_text": "t"}]}}))
    rows = readers.read_structured(spark, str(tmp_path / "r.json")).orderBy("pos").collect()
    assert [(r.pos, r.id, r.ingredients_count, r.process_steps) for r in rows] == [(0, "a", 2, 1), (1, "b", 0, 0)]
    assert readers.read_full_texts(spark, str(tmp_path / "r.json")).first().full_text == "t"


def test_scans(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"good")
    (tmp_path / "y.pdf").write_bytes(b"bad")

    def extract(data):
        if data == b"bad":
            raise ValueError("unreadable")
        return {"text": data.decode(), "numpages": 1, "info": {"Producer": "p"}}

    rows = {r.path[-5:]: r for r in readers.read_scans(spark, str(tmp_path), extract).collect()}
    assert rows["x.pdf"].text == "good" and rows["y.pdf"].error == "unreadable"


def test_fetch(tmp_path):
    assert open(readers.fetch_text("u", str(tmp_path / "d"), lambda u: b"z"), "rb").read() == b"z"


def test_streaming_upsert_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "user", "b"), (2, 1, "user", "c")], "conv_id long, turn long, role string, text string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(src)
    for k in range(2):
        q = ingest.ingest(ingest.chat_stream(spark, src), out, str(tmp_path / f"ck{k}"), lambda df: df, ["conv_id"], [F.col("turn")])
        q.awaitTermination(60)
        got = sorted((r.conv_id, r.text) for r in ingest.current(spark, out).collect())
        assert got == [(1, "b"), (2, "c")]
    assert readers.probe(spark).count() == 1


def test_steps_are_stored_and_released(spark):
    from lamplight.sources import shared

    kept = shared.stored(spark.range(5))
    assert kept.count() == 5 and all("/steps-" in f for f in kept.inputFiles())
    assert shared.release(spark) and not shared.release(spark)
