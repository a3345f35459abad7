"""Postings of three-character strings beside a table in parts: a search for a substring reads only rows that hold all of the term's.

    path/grams/part=<k>/by=<commit>/*.parquet     gram and the keys of rows of the directory of the same name under path/parts that have it, in the order of gram

A directory of rows never changes once written, so its postings are written with it and named by the same manifest: an upsert renews those of
the parts that it touches, and a reader of any commit finds the postings of just that commit. A gram is three code points of the
lower-cased text in one number, so no two share a number. Rows of a gram are neighbours in a file, whose statistics let a scan pass over all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

LENGTH = 3
#: Characters of a batch's texts whose grams are found together.
TOGETHER = 1 << 19
#: Small row groups, so that their statistics tell grams apart.
GROUP_BYTES = 4 << 20
#: Of a term's grams those are read whose postings are at most so many times as many as the rarest's, or so few in all.
TIMES, FEW = 4, 100_000
#: Texts found together from which on a gram that most of them have is named without their keys: it tells no row from another.
MANY = 100


def told(df: DataFrame, column: str) -> Column:
    """The text that a search looks into: the column's own, or the JSON of one that is no text."""
    return F.col(column) if isinstance(df.schema[column].dataType, StringType) else F.to_json(column)


def numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, gram) of all distinct grams of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = max(len(codes) - LENGTH + 1, 0)
    gram = (codes[:n] << 42) | (codes[1 : n + 1] << 21) | codes[2 : n + 2]
    inside = owner[:n] == owner[2 : n + 2]
    owner, gram = owner[:n][inside], gram[inside]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], gram[new]


def posted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams of all texts in order, how many texts have each, the places of those texts gram by gram)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    there = np.zeros(int(codes.max(initial=0)) + 1, bool)
    there[codes] = True
    letters = np.flatnonzero(there)
    if len(letters) ** 3 * len(texts) < 1 << 63:
        # letters go by their rank, so that a gram and a place are one number, which is put in order fast
        rank = (np.cumsum(there) - 1)[codes]
        n = max(len(codes) - LENGTH + 1, 0)
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = owner[:n] == owner[LENGTH - 1 :]
        both = ((rank[:n] * len(letters) + rank[1 : n + 1]) * len(letters) + rank[2:]) * len(texts) + owner[:n]
        both = np.sort(both[inside])
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        gram, owner = np.divmod(both[new], max(len(texts), 1))
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        one = gram[first]
        gram = (letters[one // len(letters) ** 2] << 42) | (letters[one // len(letters) % len(letters)] << 21) | letters[one % len(letters)]
        return gram, np.diff(np.append(first, len(owner))), owner
    owner, gram = numbers(texts)
    order = np.argsort(gram, kind="stable")
    gram, counts = np.unique(gram, return_counts=True)
    return gram, counts, owner[order]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, by, keys, text: for each gram of some rows of a part how many have it, and the keys of those unless most of MANY rows do."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        part, by = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        start = 0
        while start < len(texts):
            end, size = start + 1, len(texts[start])
            while end < len(texts) and size + len(texts[end]) <= TOGETHER and part[end] == part[start] and by[end] == by[start]:
                size += len(texts[end])
                end += 1
            gram, counts, owner = posted(texts[start:end])
            most = (counts > (end - start) / 2) & (end - start >= MANY)
            owner = owner[np.repeat(~most, counts)]
            ends = pa.array(np.append(np.concatenate([[0], np.cumsum(np.where(most, 0, counts))])[:-1], len(owner)).astype(np.int32), mask=np.append(most, False))
            keys = [pa.ListArray.from_arrays(ends, c.slice(start, end - start).take(pa.array(owner))) for c in batch.columns[2:-1]]
            named = [c.slice(start, 1).take(pa.array(np.zeros(len(gram), np.int64))) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*named, *keys, pa.array(gram), pa.array(counts)], names=[*batch.schema.names[:-1], "gram", "rows"])
            start = end


def _lists(schema: StructType, key: list[str]) -> list[StructField]:
    return [*[StructField(c, ArrayType(schema[c].dataType)) for c in key], StructField("gram", LongType()), StructField("rows", LongType())]


def write_postings(rows: DataFrame, path: str, key: list[str], column: str) -> None:
    """Postings of the rows just written, which have part and by. They are sorted where they are read: no shuffle."""
    texts = rows.select("part", "by", *key, F.lower(told(rows, column)).alias("text"))
    out = texts.mapInArrow(_postings, StructType([rows.schema["part"], rows.schema["by"], *_lists(rows.schema, key)]))
    out.sortWithinPartitions("part", "by", "gram").write.mode("append").option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").partitionBy("part", "by").parquet(f"{path}/grams")


def runs(term: str, literal: bool = False) -> list[str]:
    """What a row that matches must hold: the term's runs between wildcards (``%`` and ``_``; a backslash takes the next character as it is)."""
    if literal:
        return [term]
    out = [""]
    for escaped, wild, plain in re.findall(r"\\(.)|([%_])|(.)", term, re.DOTALL):
        if wild:
            out.append("")
        else:
            out[-1] += escaped or plain
    return [r for r in out if r]


def like(df: DataFrame, column: str, term: str, literal: bool = False) -> Column:
    text = told(df, column)
    return F.contains(F.lower(text), F.lower(F.lit(term))) if literal else text.ilike(f"%{term}%")


def rows_with(spark: SparkSession, path: str, term: str, literal: bool = False, number: int | None = None) -> DataFrame | None:
    """The table's rows whose indexed column holds the term, whatever its case, as of a commit (the last one by default); none if there is no table.

    ``%`` and ``_`` are wildcards unless ``literal``. A term whose runs are all shorter than three characters is looked for by a scan of
    all rows, as is one whose grams all are in most rows somewhere; a table that has no indexed column raises. Otherwise rows are read from the parts alone that have a row with the rarer grams of the term, and compared
    with the term: the answer is that of a scan. Null texts match nothing. The driver learns the numbers of parts and how frequent the term's grams are, no keys.
    """
    from lamplight.sources.shared import stored
    from lamplight.streaming.parts import manifest, read_parts

    m = manifest(spark, path, number)
    if m is None:
        return None
    every = read_parts(spark, path, m["number"])
    column = m.get("indexed")
    if column is None:
        raise ValueError(f"{path} keeps no postings of a column")
    # lower-cased by the same rule as the texts
    low = spark.range(1).select(*[F.lower(F.lit(r)).alias(f"r{k}") for k, r in enumerate(runs(term, literal))]).first() or []
    wanted = sorted({g for r in low for g in numbers([r])[1].tolist()})
    if not wanted or not m["parts"]:
        return every.where(like(every, column, term, literal))
    schema = StructType.fromJson(m["schema"])
    key = m["key"]
    postings = spark.read.schema(StructType([*_lists(schema, key), schema["part"]])).option("basePath", f"{path}/grams")
    if not m["grams"]:
        return every.limit(0)
    hits = postings.parquet(*[f"{path}/{d}" for d in m["grams"].values()]).where(F.col("gram").isin(wanted))
    often = {r[0]: r[1:] for r in hits.groupBy("gram").agg(F.sum("rows"), F.max(F.col(key[0]).isNull())).collect()}
    if len(often) < len(wanted):
        return every.limit(0)
    told_apart = {g: n for g, (n, unnamed) in often.items() if not unnamed}
    if not told_apart:
        return every.where(like(every, column, term, literal))
    wanted = [g for g, n in told_apart.items() if n <= max(TIMES * min(told_apart.values()), FEW)]
    hits = hits.where(F.col("gram").isin(wanted)).select("part", F.explode(F.arrays_zip(*key)).alias("k")).select("part", *[F.col("k")[c].alias(c) for c in key])
    hits = hits if len(wanted) == 1 else hits.groupBy("part", *key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")
    hits = stored(hits)
    touched = sorted(r[0] for r in hits.select("part").distinct().collect())
    if not touched:
        return every.limit(0)
    rows = spark.read.schema(schema).option("basePath", f"{path}/parts").parquet(*[f"{path}/{m['parts'][str(k)]}" for k in touched]).drop("by")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["part", *key]]
    held = rows.alias("l").join(hits.alias("r"), same, "left_semi")
    return held.where(like(held, column, term, literal))
