import corpus_pipeline as cp
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from awkward import documents, empty, texts
from lamplight.llm import exact_dedup, near_dedup, piece_fst
from lamplight.llm.toxicity import toxicity


def write(spark, tmp_path, docs):
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_on_their_own_input(spark, tmp_path):
    docs = documents(spark, texts(plain=30), extra=False)
    d = write(spark, tmp_path, docs)
    now = docs
    for name, stage in cp.STAGES:
        before = now.collect()
        out = stage(spark, now, d)
        if name != "pieces":
            assert out.columns == docs.columns
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity(now, spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 1").collect()}
            assert ids == {r.doc_id for r in before} - bad
        elif name == "exact_dedup":
            assert len(rows) == len({(r.text or "").translate({c: c + 32 for c in range(65, 91)}) for r in before})
        elif name == "near_dedup":
            assert ids < {r.doc_id for r in before} and len(rows) == len(ids)
        else:
            assert ids == {r.doc_id for r in before} and len(rows) >= len(before)
        now = spark.createDataFrame(rows, out.schema)
    assert all(r.round_trip for r in now.collect())


def test_run(spark, tmp_path):
    d = write(spark, tmp_path, documents(spark, texts(plain=10), extra=False))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "pieces"]
    out = cp.run(spark, d)
    assert out.columns == ["doc_id", "n_pieces", "ids", "round_trip"] and out.count() > 0


def test_run_on_nothing(spark, tmp_path):
    d = write(spark, tmp_path, empty(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    assert cp.run(spark, d).count() == 0


def test_extra_columns_go_through(spark, tmp_path):
    docs = documents(spark, texts(plain=5))
    d = write(spark, tmp_path, docs.select("doc_id", "text", "lang", "source", "n_chars"))
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and {r.score for r in out.select(F.col("score")).collect()} == {"own score"}


def steps_of_python(monkeypatch, spark, make):
    """The functions of batches that a plan sends to Python workers."""
    kind, runs = type(spark.range(0)), []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, f=kind.mapInArrow, **b: runs.append(run) or f(self, run, *a, **b))
    make()
    monkeypatch.undo()
    return runs


def test_workers_drop_what_another_step_keeps(spark, monkeypatch):
    """Before, the transducer and its caches (some 160 MB) stayed in each worker through all later steps of the session."""
    path = public_tokenizers.path(piece_fst.MODEL)
    (run,) = steps_of_python(monkeypatch, spark, lambda: piece_fst.encode_pieces(documents(spark)))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["A text"])], names=["doc_id", "text"])
    raw = batch.set_column(1, "text", pa.array([b"A text"], pa.binary()))
    for other, rows in ((exact_dedup._contents, raw), (near_dedup._sign, batch)):
        assert [b.num_rows for b in run(iter([batch]))] == [1]
        fst = piece_fst.load(path)
        assert [b.num_rows for b in run(iter([batch]))] == [1] and piece_fst.load(path) is fst  # the step's next task finds it
        assert [b.num_rows for b in other(iter([rows]))] == [1]
        assert piece_fst.load.cache_info().currsize == 0


def test_all_steps_of_the_pipeline_give_memory_back(spark, tmp_path, monkeypatch):
    d = write(spark, tmp_path, documents(spark, texts(plain=10), extra=False))
    runs = steps_of_python(monkeypatch, spark, lambda: cp.run(spark, d))
    assert len(runs) > 10 and all("bounded" in run.__code__.co_name for run in runs)
