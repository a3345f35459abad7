"""What several corpus operators share: table access, checkpoints, sizing and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text a Python worker turns into objects at once.
SLICE_ROWS = 500
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or the one that the session has set.

    Where neither is set, a session on one machine gets a local one; on a cluster that is an error, as executors would
    write to disks of their own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lamplight-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table in the checkpoint folder: smaller than a checkpoint, and read by column."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def integral(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def over_numbers(run, df: DataFrame, id_col: str, others: list[str], back: list[str]) -> DataFrame:
    """``run(frame, id column)`` for ids that are no integers: over their places in the order of all ids.

    ``others`` are the columns that it reads besides; ``back`` are columns of its result that hold such places, and are ids
    again in this one's. Nulls stay nulls. Ids are numbered in ranges, so no task sees them all.
    """
    raw = df.select(F.col(id_col).alias("__raw"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(others)])
    ids = raw.where("__raw is not null").select("__raw").distinct().repartitionByRange(shuffle_parts(df.sparkSession), "__raw").sortWithinPartitions("__raw")
    ids = written(ids.select("__raw", F.monotonically_increasing_id().alias("__number")))
    out = run(raw.join(ids, "__raw", "left").select(F.col("__number").alias(id_col), *[F.col(f"__{k}").alias(c) for k, c in enumerate(others)]))
    names = out.columns
    for c in back:
        out = out.join(ids.select(F.col("__number").alias(c), F.col("__raw").alias("__id")), c, "left").drop(c).withColumnRenamed("__id", c)
    return out.select(*names)


def dense_ids(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """Adds the place of each row in an order, from ``first`` on without gaps, and cuts the lineage.

    Rows are ordered in ranges; only the sizes of the ranges, a few at most per partition, are gathered.
    """
    spark = df.sparkSession
    at = written(df.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    # the upper bits of the increasing id are the partition again
    at = at.withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r[0], r[1]) for r in at.groupBy("__range").count().collect())
    before, n = {}, first
    for k, size in sizes:
        before[k], n = n, n + size
    starts = spark.createDataFrame(list(before.items()), "__range int, __before long")
    return at.join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that to a text without other characters, and is faster."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, up, up.lower()))


class Lookup(dict):
    """A bounded cache in front of a batch computation: unknown keys get a place in ``pending`` and a negative number.

    ``resolve`` computes all pending keys at once. ``hot`` entries are never evicted; the rest go when there are too many.
    """

    def __init__(self, compute, hot: dict | None = None, most: int = 200_000, longest: int = 80):
        super().__init__(hot or {})
        self.compute, self.hot, self.most, self.longest, self.pending = compute, hot or {}, most + len(hot or {}), longest, []

    def __missing__(self, key):
        self.pending.append(key)
        self[key] = k = -len(self.pending)
        return k

    def numbers(self, keys: list) -> np.ndarray:
        """Values of keys (numbers not below 0); misses are computed once each."""
        out = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        if self.pending:
            got = self.resolve()
            low = out < 0
            out[low] = np.asarray(got, np.int64)[-out[low] - 1]
        return out

    def resolve(self) -> list:
        keys, self.pending = self.pending, []
        got = self.compute(keys)
        if len(self) > self.most:
            self.clear()
            self.update(self.hot)
        else:
            for k, v in zip(keys, got):
                if len(k) <= self.longest:
                    self[k] = v
                else:
                    del self[k]
        return got


def slices(batch, text_at: int, size=None, rows: int = SLICE_ROWS, most: int = SLICE_BYTES):
    """Parts of an Arrow batch that hold a bounded number of rows and bytes of text (one long text may exceed it).

    ``size`` gives the bytes that a compressed text will have.
    """
    n = batch.num_rows
    if n == 0:
        return
    column = batch.column(text_at)
    sizes = [v or 0 for v in pc.binary_length(column).to_pylist()] if size is None else [size(v) for v in column.to_pylist()]
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= rows or total + size > most):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start, n - start)


def give_back() -> None:
    """Return to the machine what this Python worker has freed: Spark uses workers again, and they keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


#: Cached functions that the step whose tasks this Python worker runs keeps full from task to task.
_KEPT: set = set()


def enter(keeps: tuple) -> None:
    """Begin a task: what another step has kept in this Python worker goes, and what earlier ones have freed goes back."""
    if others := _KEPT.difference(keeps):
        for cached in others:
            cached.cache_clear()
        gc.collect()  # what they kept may refer to itself
    _KEPT.clear()
    _KEPT.update(keeps)
    give_back()


def lean(run, *keeps):
    """A function of batches whose worker gives memory back before it begins, as an earlier step may have left some, and at its end.

    ``keeps`` are cached functions of a module that it calls: their results stay for its next task, and go once another step's begins.
    """

    @functools.wraps(run)
    def bounded(batches):
        enter(keeps)
        yield from run(batches)
        give_back()

    return bounded


#: Edges that one task contracts.
CONTRACTED = 500_000


@lean
def _contract(batches):
    """Edges of one task as stars: each vertex with the least one that it reaches here."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        low = ids[local_components(len(ids), at[: len(u)], at[len(u) :])]
        keep = ids != low
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(low[keep])], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, comp)``, comp the smallest id reachable.

    Each round first contracts edges in tasks of at most CONTRACTED on average; where one such task holds them all, that
    settles it. Else a large-star and a small-star step follow: shuffles on one end whose minimum is a partial aggregate,
    so a hub with many neighbours is combined on the map side and no neighbour list is gathered. Every round is cut by a
    checkpoint. Only ids that occur in edges between two different ids are returned; nulls are ignored.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = cut(e.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    # a key that is computed anew is shuffled anew, so that adaptive execution may split the rows of a hub
    anew = F.shiftleft("u", 0).alias("u")
    before = None
    for k in range(rounds):
        n = e.count()
        tasks = -(-n // CONTRACTED)
        if tasks <= 1:
            e = cut(e.coalesce(1).mapInArrow(_contract, "u long, v long"))
            break
        e = cut(e.repartition(tasks, F.xxhash64("v", F.lit(k))).mapInArrow(_contract, "u long, v long"))
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(anew, F.least("u", "m").alias("m"))
        # large star: neighbours above u go to the least of u and its neighbours
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.select(anew, "m"), "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = cut(nxt.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    )


def groups_of(batches, keys: int):
    """Arrow tables of whole groups from batches sorted by their first ``keys`` columns; a group never splits."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        same = np.ones(max(n - 1, 0), bool)
        for k in range(keys):
            col = batch.column(k)
            same &= pc.equal(col.slice(1), col.slice(0, n - 1)).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        starts = [0, *(np.flatnonzero(~same) + 1).tolist(), n]
        if held and any(held[0].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip(starts, starts[1:]):
            if e == n:
                held.append(batch.slice(s))
            elif held:
                yield pa.Table.from_batches([*held, batch.slice(s, e - s)])
                held = []
            else:
                yield pa.Table.from_batches([batch.slice(s, e - s)])
    if held:
        yield pa.Table.from_batches(held)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n through the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
