"""A table of points in key-hash parts under a manifest: an upsert rewrites only the parts that its keys fall into.

    path/parts/part=<k>/by=<commit>/*.parquet     rows of one part as one commit wrote them
    path/grams/part=<k>/by=<commit>/*.parquet     postings of the same rows, where a column is indexed
    path/commits/<number>.json                    the manifest of a commit: which directory holds each part

A commit is one file that is put in its place by a rename that fails where the name is taken, so readers see all of a commit or
nothing of it, and of two writers of one number one fails. A batch that is run again finds its own name in a manifest and does nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamplight.operators.store import latest, upsert
from lamplight.streaming.grams import write_postings

#: Parts of a new table.
PARTS = 64
#: Names of the last batches that a manifest keeps; a stream runs none but its last one again.
BATCHES = 1000


class Conflict(RuntimeError):
    """Another writer has made the commit that this one wanted to make."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def commits(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, path)
    where = at(f"{path}/commits")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """The manifest of a commit, of the last one by default; none for a table that has none."""
    if number is None:
        have = commits(spark, path)
        if not have:
            return None
        number = have[-1]
    fs, at = _fs(spark, path)
    stream = fs.open(at(f"{path}/commits/{number}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    fs, at = _fs(spark, path)
    fs.mkdirs(at(f"{path}/commits"))
    draft, final = at(f"{path}/commits/.{number}-{uuid.uuid4().hex}"), at(f"{path}/commits/{number}.json")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    # stores without an atomic rename need a committer of their own; this covers file systems that have one
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"commit {number} of {path} has been made by another writer")


def read_parts(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The table as of a commit, of the last one by default, with the part of each row; a part with all its keys' rows is a directory."""
    m = manifest(spark, path, number)
    if m is None:
        return None
    where = [f"{path}/{d}" for d in m["parts"].values()]
    schema = StructType.fromJson(m["schema"])
    if not where:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/parts").parquet(*where).drop("by")


def part_of(key: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def upsert_parts(spark: SparkSession, path: str, batch: DataFrame, key: list[str], order: list[Column], name: str | None = None, parts: int = PARTS, indexed: str | None = None) -> dict:
    """Put a batch into the table, latest wins, and commit; the manifest after it.

    Only the parts that the batch's keys fall into are read and written anew; the others' directories are taken over as they are. ``name`` tells a batch that is run again: if a
    commit has it, nothing is done. A failure before the commit leaves the table as it was; what was written lies about until ``clear``.
    The number of parts is fixed by the first commit, as is ``indexed``, a column whose substrings ``grams.rows_with`` finds.
    """
    before = manifest(spark, path)
    if before and name is not None and name in before["batches"]:
        return before
    number = (before["number"] + 1) if before else 0
    count = before["of"] if before else parts
    mine = uuid.uuid4().hex
    new = batch.withColumn("part", part_of(key, count))
    touched = sorted(r[0] for r in new.select("part").distinct().collect())
    # one row of a key is enough; a batch is small beside the table
    new = latest(new, ["part", *key], order)
    held = [f"{path}/{before['parts'][str(k)]}" for k in touched if str(k) in before["parts"]] if before else []
    old = spark.read.schema(StructType.fromJson(before["schema"])).option("basePath", f"{path}/parts").parquet(*held).drop("by") if held else None
    out = new if old is None else upsert(old, new, ["part", *key], order)
    if touched:
        # a task holds parts as a whole, so a part is one file; Spark's own commit puts all of them in place at once
        out.repartition(len(touched), "part").withColumn("by", F.lit(mine)).write.mode("append").partitionBy("part", "by").parquet(f"{path}/parts")
    indexed = before.get("indexed") if before else indexed
    if touched and indexed is not None:
        written = spark.read.schema(out.withColumn("by", F.lit(mine)).schema).option("basePath", f"{path}/parts").parquet(*[f"{path}/parts/part={k}/by={mine}" for k in touched])
        write_postings(written, path, key, indexed)
    fs, at = _fs(spark, path)
    # a part whose texts are all short has no postings; others must be there when they are read
    grams = {k: d for k, d in ((before.get("grams") or {}) if before else {}).items() if int(k) not in touched}
    grams |= {str(k): d for k in touched if indexed is not None and fs.exists(at(f"{path}/{(d := f'grams/part={k}/by={mine}')}"))}
    schema = json.loads(out.schema.json())
    dirs = dict(before["parts"]) if before else {}
    dirs |= {str(k): f"parts/part={k}/by={mine}" for k in touched}
    after = {"number": number, "of": count, "parts": dirs, "schema": schema, "wrote": len(touched), "key": key, "indexed": indexed, "grams": grams, "batches": [*(before["batches"] if before else []), *([name] if name is not None else [])][-BATCHES:]}
    _commit(spark, path, number, after)
    return after


def clear(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete directories that none of the last ``keep`` commits names, and the older manifests; how many directories went.

    Readers of older commits, and writers that have not committed, must be done.
    """
    fs, at = _fs(spark, path)
    have = commits(spark, path)
    live = {d for k in have[-keep:] for d in manifest(spark, path, k)["parts"].values()}
    gone = 0
    for kind in ("parts", "grams"):
        root = at(f"{path}/{kind}")
        for part in fs.listStatus(root) if fs.exists(root) else []:
            if part.getPath().getName().startswith("part="):
                for by in fs.listStatus(part.getPath()):
                    if f"parts/{part.getPath().getName()}/{by.getPath().getName()}" not in live:
                        gone += bool(fs.delete(by.getPath(), True)) and kind == "parts"
    for k in have[:-keep]:
        fs.delete(at(f"{path}/commits/{k}.json"), False)
    return gone
