"""Embedding near-dedup by lattice hashing (operator 4).

Several random projections to eight dimensions are decoded to the nearest point of the E8 lattice. A vector belongs to
the cell of that point and to those of the next nearest points, so that it also meets vectors just across a wall. Pairs
that share a cell are verified by cosine in double precision; a pair that shares several cells is counted in the least.

Equal vectors are one row with a count before they meet a cell. A cell with many different vectors is dealt out as pairs
of blocks, each a task of bounded size. A cell hands on counts and a spanning edge per vector, never its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import components, cut, groups_of, integral, local_components, over_numbers

COSINE = 0.93
#: Tables, cells besides the nearest, and the lattice's scale: a pair at the threshold shares no cell with odds of 3 in 10^5.
TABLES = 6
NEIGHBOURS = 4
SCALE = 0.45
#: Vectors of a block on average, and pairs looked at together.
BLOCK = 2048
CHUNK = 200_000
SEED = 20240


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, by rule."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            u = np.zeros(8)
            u[i], u[j] = a, b
            out.append(u)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    f = np.rint(y)
    e = y - f
    rows = np.flatnonzero(f.sum(axis=1) % 2)
    k = np.abs(e[rows]).argmax(axis=1)
    f[rows, k] += np.where(e[rows, k] >= 0, 1, -1)
    return f


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the better of the even integer points and those moved by a half."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int = TABLES, neighbours: int = NEIGHBOURS, scale: float = SCALE) -> np.ndarray:
    """Keys of the cells of each unit vector: rows x (tables * (1 + neighbours))."""
    near = shortest()
    dims = unit.shape[1]
    weights = np.random.default_rng(SEED).integers(1, 1 << 62, 8, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    out = []
    for t in range(tables):
        turn = np.random.default_rng([SEED, dims, t]).normal(size=(dims, 8)) / np.sqrt(8)
        y = unit @ turn / scale
        p = nearest(y)
        best = np.argsort(-((y - p) @ near.T), axis=1, kind="stable")[:, :neighbours]
        all_points = np.concatenate([p[:, None], p[:, None] + near[best]], axis=1)
        whole = np.rint(all_points * 2).astype(np.int64).astype(np.uint64)
        key = (whole * weights).sum(axis=2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out.append((key ^ (key >> np.uint64(31))) >> np.uint64(4) | np.uint64(t) << np.uint64(60))
    return np.concatenate(out, axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2).to_pylist()
        n = len(lists)
        raw: list = [None] * n
        keys: list = [None] * n
        dims: list = [None] * n
        by: dict[int, list[int]] = {}
        for i, v in enumerate(lists):
            if v and batch.column(0)[i].is_valid and batch.column(1)[i].is_valid and None not in v:
                by.setdefault(len(v), []).append(i)
        for d, at in by.items():
            for s in range(0, len(at), 4096):
                part = at[s : s + 4096]
                v = np.array([lists[i] for i in part], np.float64) + 0.0  # one zero
                # scaled by the largest component first, as squares may be out of range
                with np.errstate(all="ignore"):
                    top = np.abs(v).max(axis=1)
                    fine = np.isfinite(top) & (top > 0)
                    unit = v[fine] / top[fine, None]
                    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
                for i, u, x, c in zip(np.array(part)[fine], unit, v[fine], cells(unit), strict=True):
                    raw[i], keys[i], dims[i] = x.tobytes(), c.tolist(), d
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array([None if x is None else xxhash.xxh3_128_digest(x) for x in raw], pa.binary()),
                pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["vec_id", "label", "digest", "dims", "vec", "cells"],
        )


def _links(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # label, dims, cell, i, j, side, rep, copies, vec, cells, digest
        for g in groups_of(batches, 5):
            rep, copies, side = (g.column(k).to_numpy() for k in (6, 7, 5))
            if len(rep) < 2:
                continue
            cell, i, j = (g.column(k)[0].as_py() for k in (2, 3, 4))
            v = np.frombuffer(b"".join(g.column(8).to_pylist()), np.float64).reshape(len(rep), -1)
            v = v / np.abs(v).max(axis=1)[:, None]
            v = v / np.sqrt((v**2).sum(axis=1))[:, None]
            sets = np.array(g.column(9).to_pylist(), np.int64)
            per = sets.shape[1] // TABLES
            left = np.arange(len(rep)) if i == j else np.flatnonzero(side == i)
            right = left if i == j else np.flatnonzero(side == j)
            links = np.zeros(len(rep), np.int64)
            pa_, pb_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            step = max(1, CHUNK * 4 // max(1, len(right)))
            for s in range(0, len(left), step):
                rows = left[s : s + step]
                x, y = np.nonzero(v[rows] @ v[right].T >= cosine)
                x, y = rows[x], right[y]
                if i == j:
                    x, y = x[x < y], y[x < y]
                pa_.append(x)
                pb_.append(y)
                for k in range(0, len(x), CHUNK):
                    a, b = x[k : k + CHUNK], y[k : k + CHUNK]
                    first = np.ones(len(a), bool)
                    for t in range(TABLES):  # a lesser cell that both have counts the pair instead
                        for c in range(t * per, (t + 1) * per):
                            mine = sets[a, c]
                            lower = np.flatnonzero(first & (mine < cell))
                            if len(lower):
                                first[lower[(sets[b[lower], t * per : (t + 1) * per] == mine[lower, None]).any(axis=1)]] = False
                    np.add.at(links, a[first], copies[b[first]])
                    np.add.at(links, b[first], copies[a[first]])
            x, y = np.concatenate(pa_), np.concatenate(pb_)
            if not len(x):
                continue
            # spanning edges: to the least rep of the local component
            order = np.argsort(rep, kind="stable")
            rank = np.empty(len(rep), np.int64)
            rank[order] = np.arange(len(rep))
            root = local_components(len(rep), rank[x], rank[y])
            touched = np.unique(np.concatenate([x, y]))
            yield pa.RecordBatch.from_arrays([pa.array(rep[touched]), g.column(10).take(pa.array(touched)).combine_chunks(), pa.array(links[touched]), pa.array(rep[order[root[rank[touched]]]])], names=["rep", "digest", "links", "low"])

    return run


def link_embeddings(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null, their lengths are the same and their cosine in double
    precision is at least ``cosine``. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows with a null id; each is its own component. Rows of one id with different vectors are linked by it. Repeated rows are vectors of their own and link with
    each other. Ids of any type are compared in their own order. An empty table gives no rows. Other columns are not read.
    """
    if not integral(vectors, id_col):
        return over_numbers(lambda df: link_embeddings(df, cosine, id_col, vector_col, label_col, block), vectors, id_col, [vector_col, label_col], ["vec_id", "component_id"])
    sig = cut(
        vectors.select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vector_col).cast("array<double>"))
        .mapInArrow(_signatures, "vec_id long, label string, digest binary, dims int, vec binary, cells array<long>")
    )
    # equal vectors: the least id stands for all; the digest only deals them out, contents are compared
    same = sig.where("digest is not null").groupBy("label", "dims", "digest", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("cells").alias("cells"))
    same = cut(same)
    placed = same.select("label", "dims", F.explode("cells").alias("cell"), "rep", "digest")
    sizes = placed.groupBy("label", "dims", "cell").agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.select(F.concat("label", F.lit("")).alias("label"), "dims", F.shiftleft("cell", 0).alias("cell"), F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        placed.join(sizes, ["label", "dims", "cell"]).withColumn("side", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "dims", "cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "digest")
    )
    parts = int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    near = (
        dealt.join(same, ["label", "dims", "rep", "digest"]).select("label", "dims", "cell", "i", "j", "side", "rep", "copies", "vec", "cells", "digest")
        .repartition(parts, "label", "dims", "cell", "i", "j").sortWithinPartitions("label", "dims", "cell", "i", "j", "rep")
        .mapInArrow(_links(cosine), "rep long, digest binary, links long, low long")
    )
    near = cut(near)
    comps = components(near.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    links = near.groupBy("rep", "digest").agg(F.sum("links").alias("links"))
    info = same.select("label", "dims", "digest", "vec", "rep", "copies").join(links, ["rep", "digest"], "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    info = info.select(
        F.concat("label", F.lit("")).alias("l2"), F.col("dims").alias("d2"), F.col("digest").alias("g2"), F.col("vec").alias("v2"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "rep").alias("c"),
    )
    out = sig.select("vec_id", "label", "dims", "digest", "vec").join(info, (F.col("label") == F.col("l2")) & (F.col("dims") == F.col("d2")) & (F.col("digest") == F.col("g2")) & (F.col("vec") == F.col("v2")), "left")
    comp = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))
