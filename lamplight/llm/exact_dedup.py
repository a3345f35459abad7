"""Exact dedup by skew-safe combining (operator 8).

Every row goes through three combining stages, and each compares whole contents, not digests only: rows of one task are
combined first (the partial side of the aggregate), then groups of a salted digest, then the winners of the salts. A
group that holds a third of all rows therefore reaches any task as at most one row per earlier task or salt. The way
back to the rows is a join on the digest, whose hot keys adaptive execution splits.

Contents travel compressed: the same compressor makes equal bytes of equal contents and different ones of different
contents, so comparing them compares the contents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import lean, slices

#: Salts of a digest in the second stage.
SALTS = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LEVEL = 3


def _digest(text: bytes) -> tuple[bytes, str]:
    body = text.translate(LOWER)
    return body, hashlib.sha256(body).hexdigest()


@lean
def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # id, text
    press = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for part in slices(batch, 1):
            both = [_digest(t or b"") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d for _, d in both], pa.string()), pa.array([press.compress(b) for b, _ in both], pa.binary())], names=["doc_id", "digest", "body"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(_contents, f"doc_id {kind}, digest string, body binary")


def _groups(rows: DataFrame, salts: int) -> DataFrame:
    """digest, keep_id, group_size of each content."""
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("size"))
    )
    winners = salted.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("group_size"))
    # one content per digest, or the joins on it would mix two groups: stop rather than do that
    groups = winners.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("contents"))
    groups = groups.where(F.when(F.col("contents") > 1, F.raise_error(F.lit("two contents share a digest")).cast("boolean")).otherwise(F.lit(True)))
    # the key is computed anew so that it is shuffled anew, and adaptive execution may split the rows of a hot digest
    return groups.select(F.substring("digest", 1, 64).alias("digest"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The largest doc_id of a group stays.
    Null texts count as empty; empty texts are a group like any other. A null doc_id ranks below all others, and stays
    only where its group has no other id. Rows repeated with their id count in group_size and get a row each, all kept
    if they carry keep_id. An empty table gives no rows. Other columns are not read.
    """
    rows = _rows(docs, id_col, text_col)
    return rows.select("doc_id", "digest").join(_groups(rows, salts), "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without all but one row of each group of equal texts.

    Cases as in ``exact_groups``; of rows repeated with their id, one stays.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    inner = [f"c{k}" for k in range(len(names))]
    kinds = [f.dataType.simpleString() for f in docs.schema]

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                cols = [part.column(k) for k in range(len(names))]
                cols[at] = pa.array([None if t is None else press.compress(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*cols, pa.array([_digest(t or b"")[1] for t in texts], pa.string())], names=[*inner, "digest"])

    @lean
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = zstandard.ZstdDecompressor()
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                cols = [part.column(k) for k in range(len(names))]
                cols[at] = pa.array([None if t is None else back.decompress(t).decode("utf-8", "surrogatepass") for t in cols[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=inner)

    # the winners lead straight to the rows, without the groups of all rows between
    keep = _groups(_rows(docs, id_col, text_col), SALTS).select(F.col("digest").alias("kept_digest"), F.col("keep_id").alias("keep"), "group_size")
    packed = docs.select(*[(F.col(n).cast("string").cast("binary") if k == at else F.col(n)).alias(inner[k]) for k, n in enumerate(names)])
    packed = packed.mapInArrow(pack, ", ".join(f"{c} {'binary' if k == at else kinds[k]}" for k, c in enumerate(inner)) + ", digest string")
    key = inner[names.index(id_col)]
    found = packed.join(keep, (F.col("digest") == F.col("kept_digest")) & F.col(key).eqNullSafe(F.col("keep")))
    single = found.where("group_size = 1").select(*inner)
    again = found.where("group_size > 1").dropDuplicates([key, "digest"]).select(*inner)
    out = single.unionByName(again).mapInArrow(unpack, ", ".join(f"{c} {'string' if k == at else kinds[k]}" for k, c in enumerate(inner)))
    return out.select(*[F.col(c).alias(n) for c, n in zip(inner, names, strict=True)])
