import hashlib
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from awkward import documents, empty
from lamplight.llm import exact_dedup as ed
from lamplight.llm.exact_dedup import drop_exact_copies, exact_groups


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    out = []
    for r in rows:
        g = groups[norm(r.text)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((r.doc_id, keep, len(g), r.doc_id == keep, hashlib.sha256(norm(r.text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    docs = documents(spark)
    assert sorted(map(tuple, exact_groups(docs).collect()), key=repr) == brute(docs.collect())
    assert exact_groups(empty(spark)).count() == 0


def test_drop_keeps_one_row_and_all_columns(spark):
    docs = documents(spark)
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len({norm(r.text) for r in docs.collect()})
    assert {r.doc_id for r in rows} == {x[1] for x in brute(docs.collect())}
    assert drop_exact_copies(empty(spark)).count() == 0


def test_salts_do_not_matter(spark):
    docs = documents(spark, ["Same"] * 50 + ["other"] * 3)
    assert exact_groups(docs, salts=1).orderBy("doc_id").collect() == exact_groups(docs, salts=7).orderBy("doc_id").collect()


def test_drop_of_rows_repeated_with_their_id(spark):
    docs = documents(spark, ["Same", "same", "same", "alone", None, "", "twice", "twice"], ids=[4, 4, 1, 7, 9, 9, None, None])
    out = drop_exact_copies(docs)
    assert sorted(((r.doc_id, norm(r.text)) for r in out.collect()), key=repr) == [(4, "same"), (7, "alone"), (9, ""), (None, "twice")]


def test_drop_reads_the_digests_of_all_rows_once(spark, tmp_path):
    """Before, the groups of all rows were made on the way to the rows that stay, and read every text a third time."""
    documents(spark).write.parquet(f"{tmp_path}/d")
    plan = drop_exact_copies(spark.read.parquet(f"{tmp_path}/d").where(F.col("doc_id") >= 0))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("MapInArrow _contents", plan)) == len(re.findall("MapInArrow pack", plan)) > 0


def held() -> int:
    """MB of this process."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4 // 1024


def test_memory_that_earlier_steps_have_freed_goes_back():
    pieces = [bytes(2000) for _ in range(150_000)]
    pieces = pieces[::50]  # holes between what is still held
    before = held()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"A text"], pa.binary())], names=["doc_id", "text"])
    assert [b.num_rows for b in ed._contents(iter([batch]))] == [1]
    assert held() < before - 100 and len(pieces) == 3000
