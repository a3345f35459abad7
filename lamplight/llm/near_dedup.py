"""MinHash near-dedup by order MinHash (operator 10).

A text's k-mers are its five-word shingles, each labelled by its occurrence. In each of several tables the three labelled
shingles of least rank are kept in text order and hashed to a key: texts that share a key share shingles in one order, so
keys follow edit similarity rather than set similarity. Candidates are verified by a banded alignment of the labelled
shingles: the longest chain of common shingles that rises in both texts, over all shingles of the two.

Texts with equal words are one row before they meet a table. A key's texts are first each compared with its least text
alone; the links found merge most of a group of copies. What is left are keys whose texts lie in several groups: a
sketch tells which texts may have a link across groups, only those meet again with their shingles, and every promising
pair is aligned in the task itself, in the least key that the pair shares, unless links found there have joined the
two already. A task hands on links that join groups, never its pairs, and a large key is dealt out as pairs of blocks.
Groups, links and fingerprints stay in Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import components, cut, groups_of, integral, lean, over_numbers, slices, written

WORDS = 5
SIMILARITY = 0.8
#: Tables and shingles of a key: a pair at the threshold shares no key with odds of 1 in 10^5.
TABLES = 16
KEPT = 3
#: Bins of the sketch, and the estimate under which a pair is not verified (six deviations below the threshold): a pair of long
#: texts at the threshold stays under it with odds of 1 in 10^8, so nearly all of what is missed shares no key.
BINS = 256
PROMISING = 0.65
#: Texts of a block of a key, on average, where all of a block meet, and where each meets the key's least text alone.
BLOCK = 2048
LED = 256
WORD = re.compile(r"\w+")


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_words: dict[str, int] = {}


def shingles(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(labelled shingles of all texts in their order, number in each). A text of 1 to 4 words is one shingle."""
    known = _words
    if len(known) > 300_000:
        known.clear()
    hashed = xxhash.xxh3_64_intdigest

    def number(w: str) -> int:
        v = known.get(w)
        if v is None:
            v = known[w] = hashed(w.encode("utf-8", "surrogatepass"))
        return v

    n = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((number(w) for x in lists for w in x), np.uint64, int(n.sum()))
    count = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
    starts = np.repeat(np.cumsum(n) - n, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    stop = np.repeat(np.cumsum(n), count)
    padded = np.concatenate([flat, np.zeros(WORDS, np.uint64)])
    h = np.zeros(len(starts), np.uint64)
    for k in range(WORDS):
        h = _mix(h + np.where(starts + k < stop, padded[starts + k], np.uint64(0)), 0x51ED27 + k)
    owner = np.repeat(np.arange(len(lists)), count)
    order = np.lexsort((h, owner))
    again = np.zeros(len(h), np.int64)
    if len(h):
        s, o = h[order], owner[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])
        first = np.flatnonzero(new)
        again[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.where(again > 0, _mix(h + again.astype(np.uint64), 0xA6A1), h), count


def signatures(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys: texts x tables, sketches: texts x bins, 0 where a bin is empty)."""
    n = len(count)
    keys = np.zeros((n, TABLES), np.int64)
    sketch = np.zeros((n, BINS), np.uint8)
    some = np.flatnonzero(count)
    if not len(some):
        return keys, sketch
    sizes = count[some]
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(some)), sizes)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(TABLES):
        rank = _mix(h, 0x9D5C0 + 7919 * t)
        at = []
        for _ in range(KEPT):
            low = np.minimum.reduceat(rank, starts)
            hit = np.flatnonzero((rank == low[owner]) & (low[owner] != top))
            who = owner[hit]
            first = np.ones(len(hit), bool)
            first[1:] = who[1:] != who[:-1]
            hit = hit[first]
            place = np.full(len(some), np.iinfo(np.int64).max)
            place[who[first]] = hit
            rank[hit] = top
            at.append(place)
        ordered = np.sort(np.stack(at, axis=1), axis=1)
        key = np.full(len(some), np.uint64(t), np.uint64)
        for k in range(KEPT):
            p = ordered[:, k]
            there = p < len(h)
            key = _mix(key + np.where(there, h[np.where(there, p, 0)], np.uint64(1)), 0x77 + k)
        keys[some, t] = key.view(np.int64)
    r = _mix(h, 0x5EED)
    bins = owner * BINS + (r >> np.uint64(56)).astype(np.int64)
    low = np.full(len(some) * BINS, top)
    np.minimum.at(low, bins, r)
    value = (_mix(low, 3) >> np.uint64(50)) % np.uint64(255) + np.uint64(1)
    sketch[some] = np.where(low == top, 0, value).astype(np.uint8).reshape(-1, BINS)
    return keys, sketch


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Banded alignment of labelled shingles: the longest common rising chain over the union; 0 where below ``similarity``.

    A pair that reaches it leaves at most (1 - similarity) / (1 + similarity) of all shingles unmatched, so places in its chain
    differ by no more than that: the band loses nothing. Labelled shingles are unique in a text.
    """
    both = len(a) + len(b)
    need = similarity * both / (1 + similarity)
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need - 1e-9:
        return 0.0
    near = np.abs(i - j) <= both - 2 * need + 1e-9
    i, j = i[near], j[near]
    j = j[np.argsort(i, kind="stable")]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        ends: list[int] = []
        for x in j.tolist():
            k = bisect_left(ends, x)
            if k == len(ends):
                ends.append(x)
            else:
                ends[k] = x
        m = len(ends)
    else:
        m = len(j)
    s = m / (both - m) if both else 0.0
    return s if s >= similarity - 1e-12 else 0.0


@lean
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            lists = [WORD.findall(t.lower()) if t else [] for t in part.column(1).to_pylist()]
            h, count = shingles(lists)
            keys, sketch = signatures(h, count)
            digest = [xxhash.xxh3_128_digest(" ".join(x).encode("utf-8", "surrogatepass")) if x else None for x in lists]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()), pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * TABLES), pa.array(keys.ravel())),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                ],
                names=["doc_id", "digest", "keys", "sketch"],
            )


def alike(sketch: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of text k to others, by the bins that hold something."""
    mine, theirs = sketch[k], sketch[others]
    same = ((theirs == mine) & (theirs > 0)).sum(axis=1)
    return same / np.maximum(((theirs > 0) | (mine > 0)).sum(axis=1), 1)


@lean
def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a key with the key's least text, where that is promising."""
    # key, rep, sketch
    for g in groups_of(batches, 1):
        rep = g.column(1).to_numpy()
        sketch = np.frombuffer(b"".join(g.column(2).to_pylist()), np.uint8).reshape(-1, BINS)
        lead = int(rep.argmin())
        others = np.flatnonzero(np.arange(len(rep)) != lead)
        if len(others):
            good = others[alike(sketch, lead, others) >= PROMISING]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), rep[lead])), pa.array(rep[good])], names=["a", "b"])


def _sides(g: pa.Table, at: int) -> list[tuple[int, np.ndarray]]:
    """(text, the texts it meets here) for a block, or for a pair of blocks; columns at, at + 1, at + 2 are i, j and side."""
    i, j, side = g.column(at)[0].as_py(), g.column(at + 1)[0].as_py(), g.column(at + 2).to_numpy()
    n = len(side)
    if i == j:
        return [(k, np.arange(k + 1, n)) for k in range(n - 1)]
    right = np.flatnonzero(side == j)
    return [(k, right) for k in np.flatnonzero(side == i).tolist()]


@lean
def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that may have a link to another group of their key, once for each block pair."""
    # key, i, j, side, rep, comp, sketch
    for g in groups_of(batches, 3):
        rep, comp = g.column(4).to_numpy(), g.column(5).to_numpy()
        if comp.min() == comp.max():
            continue
        sketch = np.frombuffer(b"".join(g.column(6).to_pylist()), np.uint8).reshape(-1, BINS)
        hit = np.zeros(len(rep), bool)
        for k, others in _sides(g, 1):
            others = others[comp[others] != comp[k]]
            if len(others):
                others = others[alike(sketch, k, others) >= PROMISING]
                hit[others] = True
                hit[k] |= len(others) > 0
        if hit.any():
            take = pa.array(np.flatnonzero(hit))
            yield pa.RecordBatch.from_arrays([g.column(c).take(take).combine_chunks() for c in range(7)], names=["key", "i", "j", "side", "rep", "comp", "sketch"])


def _settle(similarity: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # key, i, j, side, rep, comp, sketch, keys, h
        for g in groups_of(batches, 3):
            key, rep = g.column(0)[0].as_py(), g.column(4).to_numpy()
            comp = np.unique(g.column(5).to_numpy(), return_inverse=True)[1]
            sketch = np.frombuffer(b"".join(g.column(6).to_pylist()), np.uint8).reshape(-1, BINS)
            keys = np.array(g.column(7).to_pylist(), np.int64)
            mine = int(np.flatnonzero((keys == key).any(axis=0))[0])
            h = [np.frombuffer(x, np.uint64) for x in g.column(8).to_pylist()]
            links = []
            for k, others in _sides(g, 1):
                others = others[comp[others] != comp[k]]
                if not len(others):
                    continue
                est = alike(sketch, k, others)
                others, est = others[est >= PROMISING], est[est >= PROMISING]
                others = others[~(keys[others][:, :mine] == keys[k, :mine]).any(axis=1)]  # a pair belongs to the first table that it shares
                for o in others.tolist():
                    if comp[o] != comp[k] and aligned(h[k], h[o], similarity):
                        links.append((rep[k], rep[o]))
                        comp[comp == comp[o]] = comp[k]
            if links:
                a = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    return run


@lean
def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            h, count = shingles([WORD.findall(t.lower()) if t else [] for t in part.column(1).to_pylist()])
            ends = np.cumsum(count)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[e - n : e].tobytes() for e, n in zip(ends, count, strict=True)], pa.binary())], names=["id", "h"])


def _verify(similarity: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            s = [aligned(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id reachable by links), kept (doc_id = class_id).

    Words are runs of letters, digits and underscores, lower-cased; texts of equal words are linked. Other texts are
    linked by an aligned similarity of at least ``similarity``. Null texts, empty ones and ones without words link with
    nothing, nor do rows with a null id (their class is null). Rows repeated with their id get a row each; rows of one id
    with different texts are linked by it. Ids of any type are compared in their own order. An empty table gives no rows. Other columns are not read.
    """
    if not integral(docs, id_col):
        return over_numbers(lambda df: near_groups(df, id_col, text_col, similarity), docs, id_col, [text_col], ["doc_id", "class_id"])
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = cut(rows.mapInArrow(_sign, "doc_id long, digest binary, keys array<long>, sketch binary"))
    live = sig.where("digest is not null and doc_id is not null")
    if live.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").limit(1).count():
        return _of_rows(rows, similarity)
    same = live.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    same = cut(same)
    placed = same.select("rep", F.explode("keys").alias("key"))
    sizes = placed.groupBy("key").agg(F.count_distinct("rep").alias("size")).where("size > 1").select(F.shiftleft("key", 0).alias("key"), F.ceil(F.col("size") / LED).cast("int").alias("shares"))
    shared = placed.distinct().join(sizes, "key")
    signs = same.select("rep", "sketch", "keys").dropDuplicates(["rep"])
    buckets = cut(shared.join(signs.select("rep", "sketch"), "rep").select("key", "rep", "sketch", "shares"))
    met = buckets.select(F.col("rep").alias("id")).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a key's least text is an aggregate; it goes to each share of the key's texts, so no key is gathered
    share = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shares")).cast("int")
    least = buckets.groupBy("key").agg(F.min(F.struct("rep", "sketch")).alias("low"), F.max("shares").alias("shares"))
    least = least.select("key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "low.rep", "low.sketch")
    shares = buckets.select("key", share.alias("share"), "rep", "sketch").unionAll(least).select(F.xxhash64("key", "share").alias("key"), "rep", "sketch")
    led = cut(shares.repartition(parts, "key").sortWithinPartitions("key", "rep").mapInArrow(_lead, "a long, b long").where("a <> b").distinct())
    held = cut(rows.withColumnRenamed("doc_id", "id").join(met, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_hold, "id long, h binary"))
    one = led.join(held.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    two = one.join(held.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").select("a", "b", "ha", "hb")
    links = cut(two.mapInArrow(_verify(similarity), "a long, b long, similarity double").where("similarity > 0").select("a", "b"))
    comps = components(links)
    # keys whose texts lie in several groups
    now = cut(buckets.drop("shares").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"), "sketch"))
    open_keys = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high")
    open_keys = open_keys.select(F.shiftleft("key", 0).alias("key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        now.join(open_keys, "key").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "comp", "sketch")
    )
    kind = "key long, i int, j int, side int, rep long, comp long, sketch binary"
    again = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(_promising, kind)
    again = again.join(signs.select("rep", "keys"), "rep").join(held.select(F.col("id").alias("rep"), "h"), "rep").select("key", "i", "j", "side", "rep", "comp", "sketch", "keys", "h")
    more_links = cut(again.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(_settle(similarity), "a long, b long").distinct())
    links = links.unionAll(more_links)
    comps = components(links)
    ids = live.select("doc_id", "digest").join(same.select(F.concat("digest", F.lit(b"")).alias("digest"), "rep"), "digest").select("doc_id", "rep").distinct()
    classes = ids.join(comps.withColumnRenamed("id", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("class"))
    out = sig.select("doc_id").join(classes, "doc_id", "left")
    class_id = F.coalesce("class", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def _of_rows(rows: DataFrame, similarity: float) -> DataFrame:
    """``near_groups`` of rows (doc_id, text) some of whose ids have several texts: rows are compared as documents of their own, then classes that share an id are one."""
    numbered = written(rows.where("doc_id is not null").withColumn("number", F.monotonically_increasing_id()))
    found = near_groups(numbered, "number", "text", similarity).select(F.col("doc_id").alias("number"), "class_id")
    of_class = written(numbered.select("number", "doc_id").join(found, "number").select("doc_id", "class_id"))
    low = of_class.groupBy("class_id").agg(F.min("doc_id").alias("low"))
    comps = components(of_class.join(low.select(F.shiftleft("class_id", 0).alias("class_id"), "low"), "class_id").select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    out = rows.select("doc_id").join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    class_id = F.coalesce("comp", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The input's rows and columns without all but one document of each class; cases as in ``near_groups``.

    Rows without words or id stay. Rows repeated with the id that stays all stay.
    """
    keep = near_groups(docs, id_col, text_col, similarity).where("kept").select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col("__keep")), "left_semi")
