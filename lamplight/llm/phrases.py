"""Phrase collocations by dictionary ids, packed keys, a range-partitioned radix sort and run lengths (operator 11).

Texts become streams of word numbers in blocks of bounded size, each with its own dictionary. Counts of all blocks make
one dictionary of the words that are frequent in their language; a join hands each block the ids of its words, so no
dictionary is broadcast or gathered, at any size. Other words break the streams as punctuation does. Every position gives
one key of 15 bytes: the ids of a word and the next two, 0 where the third breaks. Blocks radix-sort and count their keys,
runs are cut at the boundaries of key ranges, and each range is sorted again and counted: equal windows are trigrams, and
windows that begin alike add up to bigrams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.llm.common import dense_ids, groups_of, shuffle_parts, slices, written

#: Text of a block, distinct words of a block, bytes of text that become objects at once.
BLOCK_BYTES, BLOCK_WORDS, PIECE_BYTES = 16 << 20, 1 << 18, 4 << 20
#: Keys of a range, one sampled key of a run in so many, samples that are gathered at most, ranges at most.
RANGE_KEYS, STRIDE, SAMPLES, RANGES = 1 << 20, 1 << 14, 1 << 20, 1 << 18
#: Bits of an id; three of them are a key.
ID_BITS = 40
LEAST, TOP, DROP_SHARE = 10, 2000, 50
SALTS = 32

#: Ends of pieces become line feeds, tabs spaces (fixed values: the characters that split texts).
_SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_WORD, _GAP = re.compile(rb"[^ \n]+|\n"), re.compile(rb"[ \n]")


class _Numbers(dict):
    """Numbers of words in the order of their first occurrence; 0 is the break."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed byte planes, each as wide as its largest number needs."""
    n = len(columns[0])
    out = [np.array([n, len(columns)], np.uint64).tobytes()]
    for c in columns:
        width = max(1, -(-int(c.max()).bit_length() // 8)) if n else 1
        planes = np.ascontiguousarray(c.astype("<u8", copy=False).view(np.uint8).reshape(n, 8)[:, :width].T).tobytes()
        squeezed = pa.compress(planes, codec="zstd", asbytes=True)
        out += [np.array([width, len(squeezed)], np.uint64).tobytes(), squeezed]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n, count = np.frombuffer(data, np.uint64, 2).tolist()
    out, at = [], 16
    for _ in range(count):
        width, size = np.frombuffer(data, np.uint64, 2, at).tolist()
        planes = np.frombuffer(pa.decompress(data[at + 16 : at + 16 + size], n * width, codec="zstd"), np.uint8).reshape(width, n)
        column = np.zeros((n, 8), np.uint8)
        column[:, :width] = planes.T
        out.append(column.view("<u8").reshape(n))
        at += 16 + size
    return out


def keys_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three ids of 40 bits as the upper 64 and the lower 56 bits of a key."""
    return a << np.uint64(24) | b >> np.uint64(16), (b & np.uint64(0xFFFF)) << np.uint64(ID_BITS) | c


def ids_of(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return high >> np.uint64(24), (high & np.uint64(0xFFFFFF)) << np.uint64(16) | low >> np.uint64(ID_BITS), low & np.uint64((1 << ID_BITS) - 1)


def radix_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order of keys, by digits of 16 bits from the lowest; digits that are all alike are passed over."""
    order = np.arange(len(high))
    for column in (low, high):
        for shift in range(0, 64, 16):
            digit = (column >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, sums of counts) of the distinct keys, in order."""
    order = radix_order(high, low)
    high, low = high[order], low[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(high)), bool), (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    if counts is None:
        n = np.diff(np.append(starts, len(high)))
    else:
        n = np.add.reduceat(counts[order], starts) if len(starts) else np.empty(0, np.int64)
    return high[starts], low[starts], n.astype(np.int64)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to blocks: (part, lang, n, words, counts, stream), one row of a language and block."""
    part = TaskContext.get().partitionId() << 32
    held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    size = 0

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal part
        for lang, (numbers, streams) in held.items():
            stream = np.concatenate(streams)
            counts = np.bincount(stream, minlength=len(numbers))
            counts[0] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()), pa.array([lang], pa.string()), pa.array([int(counts.sum())], pa.int64()), pa.array([list(numbers)], pa.list_(pa.binary())),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([pack(stream.astype(np.uint64))], pa.binary()),
                ],
                names=["part", "lang", "n", "words", "counts", "stream"],
            )
            part += 1

    for batch in batches:
        for some in slices(batch, 1):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append((text or "").encode())
            for lang, texts in by_lang.items():
                numbers, streams = held.setdefault(lang, (_Numbers(), []))
                # a text ends as a piece does
                blob = b"".join(t + b"\n" for t in texts).lower().translate(_SPLIT)
                at = 0
                while at < len(blob):
                    gap = _GAP.search(blob, at + PIECE_BYTES) if len(blob) - at > PIECE_BYTES else None
                    stop = gap.start() if gap else len(blob)
                    words = _WORD.findall(blob, at, stop)
                    streams.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    at = stop
                size += len(blob)
            if size >= BLOCK_BYTES or sum(len(v[0]) for v in held.values()) >= BLOCK_WORDS:
                yield from block()
                held, size = {}, 0
    yield from block()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream, places, ids) of blocks to their sorted, counted keys with a few sampled ones."""
    for batch in batches:
        for k in range(batch.num_rows):
            (stream,) = unpack(batch.column(0)[k].as_py())
            places, ids = (batch.column(c)[k].values.to_numpy() for c in (1, 2))
            number = np.zeros(int(stream.max(initial=0)) + 1, np.uint64)
            number[places] = ids
            x = np.concatenate([number[stream], np.zeros(2, np.uint64)])
            at = np.flatnonzero((x[:-2] > 0) & (x[1:-1] > 0))
            if len(at):
                high, low, n = run_lengths(*keys_of(x[at], x[at + 1], x[at + 2]))
                some = np.arange(min(STRIDE // 2, len(high) // 2), len(high), STRIDE)
                sampled = [h.to_bytes(8, "big") + v.to_bytes(7, "big") for h, v in zip(high[some].tolist(), low[some].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(high)], pa.int64()), pa.array([sampled], pa.list_(pa.binary())), pa.array([_run(high, low, n)], pa.binary())], names=["n", "sampled", "run"]
                )


def _run(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> bytes:
    """A sorted run: first ids as steps, second and third ones plain, counts less one."""
    a, b, c = ids_of(high, low)
    return pack(np.diff(a, prepend=np.uint64(0)), b, c, n.astype(np.uint64) - np.uint64(1))


def _unrun(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, c, n = unpack(data)
    return *keys_of(np.cumsum(a, dtype=np.uint64), b, c), n.astype(np.int64) + 1


def places_of(high: np.ndarray, low: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each cut, how many keys of a sorted run lie below it."""
    left, right = np.searchsorted(high, cuts[0], "left"), np.searchsorted(high, cuts[0], "right")
    for k in np.flatnonzero(left < right).tolist():
        left[k] += np.searchsorted(low[left[k] : right[k]], cuts[1][k], "left")
    return left


def phrase_counts(runs: DataFrame, least: int = LEAST) -> DataFrame:
    """(a, b, c, n) of the windows in at least ``least`` places, and (a, b, 0, n) of the word pairs that are; all others are left out."""
    spark = runs.sparkSession
    total, sampled = runs.agg(F.sum("n"), F.sum(F.size("sampled"))).first()
    ranges = min(RANGES, -(-(total or 0) // RANGE_KEYS)) or 1
    keys = runs.select(F.explode("sampled").alias("k"))
    share = SAMPLES / max(sampled or 1, 1)
    if share < 1:
        keys = keys.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = sorted(bytes(r[0]) for r in keys.collect())
    cuts = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    shared = spark.sparkContext.broadcast((np.array([int.from_bytes(k[:8], "big") for k in cuts], np.uint64), np.array([int.from_bytes(k[8:], "big") for k in cuts], np.uint64)))

    def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                high, low, n = _unrun(data.as_py())
                ends = [0, *places_of(high, low, shared.value).tolist(), len(high)]
                rows = [(k, _run(high[s:e], low[s:e], n[s:e])) for k, (s, e) in enumerate(zip(ends, ends[1:])) if s < e]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], names=["range", "run"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1):
            high, low, n = run_lengths(*(np.concatenate(x) for x in zip(*[_unrun(r.as_py()) for r in group.column(1)])))
            a, b, c = ids_of(high, low)
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            pairs = np.add.reduceat(n, starts)
            # a pair at an end of the range may go on in the next one
            keep = pairs >= least
            keep[[0, -1]] = True
            wide = np.flatnonzero((c > 0) & (n >= least))
            columns = [np.concatenate([x[wide], x[starts[keep]]]).astype(np.int64) for x in (a, b)]
            columns += [np.concatenate([c[wide], np.zeros(int(keep.sum()), np.uint64)]).astype(np.int64), np.concatenate([n[wide], pairs[keep]])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "c", "n"])

    dealt = runs.select("run").mapInArrow(cut_runs, "range int, run binary").repartition(max(len(cuts) + 1, 1), "range").sortWithinPartitions("range")
    return dealt.mapInArrow(count, "a long, b long, c long, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"), wide(left) * wide(right))


def best_of(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``; a language is ranked in salted parts first, so that no task orders all its rows."""
    some = Window.partitionBy("lang", "__salt").orderBy(*order)
    parts = rows.withColumn("__salt", F.pmod(F.xxhash64("a_id", "b_id", "c_id"), F.lit(SALTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    return parts.drop("__salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of two and three words of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased in A-Z, split at ``. , ; : ! ?`` and line ends into pieces, those at spaces and tabs into words. ``n``
    counts the language's words, ``a`` the phrase in pieces, overlaps included, ``l`` and ``r`` the two parts of the cut with the least score
    floor(1000000 a a / (l r)), the first of equal ones. Phrases in fewer than ``least`` places are none; one of two words is dropped where a phrase
    of three around it has at least half its count. Order: score and a descending, phrase ascending by bytes.
    Null texts are empty, a null language is ``und``; repeated rows count each time, ids are not read; languages without such a phrase, and empty tables, give no rows.
    Whole texts of any length count; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    blocks = written(texts.mapInArrow(_streams, "part long, lang string, n long, words array<binary>, counts array<long>, stream binary"))
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("total"))
    words = blocks.select("part", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).where("place > 0").select("part", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counted = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    known = dense_ids(counted, [F.desc("n"), F.col("lang"), F.col("word")], "id", first=1)
    # keys that are computed anew are shuffled anew, so that adaptive execution may split a word that every block has
    named = words.join(known.select(F.concat("lang").alias("lang"), F.concat("word").alias("word"), "id"), ["lang", "word"])
    of_block = named.groupBy("part").agg(F.collect_list(F.struct("place", "id")).alias("k")).select("part", "k.place", "k.id")
    runs = written(blocks.select("part", "stream").join(of_block, "part").select("stream", "place", "id").mapInArrow(_windows, "n long, sampled array<binary>, run binary"))
    counts = written(phrase_counts(runs, least))

    one = known.select("id", F.col("n").alias("f"))
    pairs = counts.where("c = 0").drop("c").join(known.select(F.col("id").alias("a"), "lang", F.col("n").alias("fa")), "a").join(one.select(F.col("id").alias("b"), F.col("f").alias("fb")), "b")
    three = counts.where("c > 0")
    around = three.select("a", "b", "n").unionAll(three.select("b", "c", "n")).groupBy("a", "b").agg(F.max("n").alias("most"))
    two = pairs.join(around, ["a", "b"], "left").where(F.coalesce(F.lit(100) * F.col("most") < F.lit(DROP_SHARE) * F.col("n"), F.lit(True)))
    two = two.select("lang", F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.lit(0).cast("long").alias("c_id"), F.col("n").alias("a"), F.col("fa").alias("l"), F.col("fb").alias("r"))
    left = pairs.select("a", "b", "lang", "fa", F.col("n").alias("fab"))
    right = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("fbc"), F.col("fb").alias("fc"))
    cut = three.join(left, ["a", "b"]).join(right, ["b", "c"]).withColumns({"s1": _score(F.col("n"), F.col("fa"), F.col("fbc")), "s2": _score(F.col("n"), F.col("fab"), F.col("fc"))})
    first = F.col("s1") <= F.col("s2")
    cut = cut.select(
        "lang", F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.col("c").alias("c_id"), F.col("n").alias("a"), F.when(first, F.col("fa")).otherwise(F.col("fab")).alias("l"), F.when(first, F.col("fbc")).otherwise(F.col("fc")).alias("r")
    )
    found = written(two.unionByName(cut).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))))

    # phrases are spelled out only from the last place's score and count on
    edge = best_of(found, top, F.desc("score"), F.desc("a")).where(F.col("rank") == top).select(F.col("lang").alias("__lang"), F.col("score").alias("__score"), F.col("a").alias("__a"))
    near = found.join(edge, F.col("lang") == F.col("__lang"), "left").where("__lang is null or score > __score or score = __score and a >= __a").drop("__lang", "__score", "__a")
    spelled = near
    for c in "abc":
        spelled = spelled.join(known.select(F.col("id").alias(f"{c}_id"), F.col("word").cast("string").alias(f"{c}_word")), f"{c}_id", "left")
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", "a_word", "b_word", "c_word"))
    ranked = best_of(spelled, top, F.desc("score"), F.desc("a"), F.col("phrase"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
