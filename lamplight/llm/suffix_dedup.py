"""Suffix-array dedup by parsing into phrases (operator 3).

A rolling hash over short grams picks triggers so that every string of the match length holds one, chosen by its own bytes
alone: the least hash in it. The phrase of a trigger reaches as far to both sides as any such string around it can. Equal strings
thus lie at equal places of phrases with equal triggers, and texts need comparing only phrase by phrase.

The parse of a text is its phrases. Their occurrences are dealt out by trigger as hashes. A phrase that also occurs in a lesser
document is covered whole; highly repetitive text ends there, as its dictionary of phrases is small. What is left are
phrases that share a trigger but differ, the ends of repeated passages. One of each enters the dictionary with its bytes:
the suffixes that end in a trigger are sorted, so are the suffixes of the parse that begin with it, and a string of
the match length is an interval of the one order and one of the other. The first document of each such pair owns the string; all others lose it.

No trigger is gathered whole where many texts hold it: phrases of hot triggers are dealt out by phrase, and the strings around a trigger
with too many different phrases are told apart by digests in an aggregate of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import groups_of, integral, over_numbers, written

LENGTH = 50
#: Bytes of a trigger; longer ones meet less by chance, shorter ones are fewer.
GRAM = 20
#: Bytes of text parsed together and hashed together, dictionary phrases sorted together, occurrences settled together, bytes of a hash that are dealt out.
PARSED = 1 << 20
WINDOW = 1 << 17
SORTED = 20_000
SETTLED = 400_000
HASHED = 6
#: Documents whose phrases are cut out together, and phrases whose strings are.
FETCHED = 250
DIGESTED = 2_000
#: One document in so many is looked at for hot triggers, and how often one must occur there.
SAMPLED = 64
SEEN = 50
BEFORE = LENGTH - GRAM
SPAN = BEFORE + LENGTH


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h += b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each ``width`` consecutive values (results at the first of them)."""
    have, y = 1, x
    while have * 2 <= width:
        y = f(y[: len(y) - have], y[have:])
        have *= 2
    return y if have == width else f(y[: len(x) - width + 1], y[width - have : width - have + len(x) - width + 1])


def triggers(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of triggers, their hashes, hashes of their phrases) in texts laid end to end.

    Whether a place is a trigger, and its phrase, hang on the bytes of one phrase around it, so windows that overlap by as much
    see what the whole would show; memory does not grow with a text's length.
    """
    n = len(buffer)
    parts = []
    for a in range(0, max(n, 1), WINDOW):
        low, high = max(a - BEFORE, 0), min(a + WINDOW + LENGTH, n)
        some = slice(np.searchsorted(starts + sizes, low, side="right"), np.searchsorted(starts, high))
        begin = np.maximum(starts[some], low)
        at, gram, phrase = _triggers(buffer[low:high], begin - low, np.minimum(starts[some] + sizes[some], high) - begin)
        own = (at >= a - low) & (at < a - low + WINDOW)
        parts.append((at[own] + low, gram[own], phrase[own]))
    at, gram, phrase = (np.concatenate(x) for x in zip(*parts, strict=True))
    return at, gram, phrase


def _triggers(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = len(buffer)
    if n < LENGTH:
        return none
    codes = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
    h = codes[buffer]
    four = None
    for k in (1, 2, 4, 8):
        h = _join(h[: len(h) - k], h[k:])
        four = h if k == 2 else four
    sixteen = h
    gram = _join(sixteen[: n - GRAM + 1], four[16 : 16 + n - GRAM + 1])
    least = _slide(gram, LENGTH - GRAM + 1, np.minimum)  # by start of a string of the match length
    inside = np.zeros(n + 1, np.int32)
    some = sizes >= LENGTH
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, (starts + sizes)[some] - LENGTH + 1, -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    width = LENGTH - GRAM + 1
    reach = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = _slide(reach, width, np.maximum)[: len(gram)] == gram
    at = np.flatnonzero(chosen)
    if not len(at):
        return none
    owner = np.searchsorted(starts, at, side="right") - 1
    begin, end = starts[owner], starts[owner] + sizes[owner]
    whole = (at - BEFORE >= begin) & (at + LENGTH <= end)
    phrase = np.zeros(len(at), np.uint64)
    p = at[whole] - BEFORE
    v = sixteen[p]
    for k in range(16, SPAN, 16):
        v = _join(v, sixteen[p + k])
    phrase[whole] = v
    raw = buffer.tobytes()
    for i in np.flatnonzero(~whole).tolist():
        t = int(at[i])
        s, e = max(t - BEFORE, int(begin[i])), min(t + LENGTH, int(end[i]))
        phrase[i] = xxhash.xxh3_64_intdigest(raw[s:e], seed=1 + t - s)
    return at, gram[at], phrase


def _pieces(column, most: int):
    """(first row, texts) of runs of rows with at most ``most`` bytes together, or one row; only one run's texts are held."""
    start = total = 0
    for i, size in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if i > start and total + size > most:
            yield start, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += size
    if len(column) > start:
        yield start, column.slice(start).to_pylist()


def mark(text: bytes | None) -> int:
    """Tells rows of one id apart."""
    return xxhash.xxh32_intdigest(text or b"") - (1 << 31)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as differences, low bytes first, compressed."""
    d = np.diff(x.astype(np.int64), prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.int64).ravel())


def _short(h: np.ndarray) -> bytes:
    return h.view(np.uint8).reshape(-1, 8)[:, 8 - HASHED :].tobytes()


def _long(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, HASHED)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :HASHED] = raw
    return out.view(np.uint64).ravel()


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triggers of texts with their counts. text"""
    for batch in batches:
        for _, texts in _pieces(batch.column(0), PARSED):
            sizes = np.array([len(t or b"") for t in texts], np.int64)
            _, gram, _ = triggers(np.frombuffer(b"".join(t or b"" for t in texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
            keys, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["gram", "n"])


def hot_triggers(known: DataFrame, parts: int) -> np.ndarray:
    """Triggers that hold more than a sixteenth of an average bucket in a sample of documents: at most 16 for each bucket.

    They only choose a way for their phrases; both ways give the same.
    """
    counts = known.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_frequent, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("n") >= SEEN))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * (16 * parts) > total).select("gram").toArrow().column(0).to_numpy()
    return np.sort(_long([_short(hot.astype(np.int64).view(np.uint64))])) if len(hot) else np.zeros(0, np.uint64)


def _in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return np.isin(wanted, keys) if len(keys) else np.zeros(len(wanted), bool)


def _parse(buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_all = batch.column(0).to_numpy()
            for first, texts in _pieces(batch.column(1), PARSED):
                ids, marks = ids_all[first : first + len(texts)], np.fromiter(map(mark, texts), np.int32, len(texts))
                sizes = np.array([len(t or b"") for t in texts], np.int64)
                starts = np.cumsum(sizes) - sizes
                at, gram, phrase = triggers(np.frombuffer(b"".join(t or b"" for t in texts), np.uint8), starts, sizes)
                if not len(at):
                    continue
                owner = np.searchsorted(starts, at, side="right") - 1
                owner = np.minimum(owner, len(starts) - 1)
                # of equal phrases here, those of the least document go on; the others are covered already
                order = np.lexsort((ids[owner], phrase, gram))
                g, f = gram[order], phrase[order]
                new = np.concatenate([[True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])])
                least = ids[owner[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
                known = np.zeros(len(at), bool)
                known[order] = ids[owner[order]] > least
                # phrases of one trigger lie together, but those of a hot one are dealt out by phrase
                deal = np.where(_in(hot, _long([_short(gram)])), _long([_short(phrase)]) >> np.uint64(7), gram)
                bucket = (deal % np.uint64(buckets)).astype(np.int64)
                bucket[known] = buckets + bucket[known]  # a bucket of their own, beside
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                rows: list[tuple] = []
                for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                    take = order[s:e]
                    docs, back = np.unique(owner[take], return_inverse=True)
                    place = at[take] - starts[owner[take]]
                    rows.append((int(bucket[take[0]]), _pack(ids[docs]), marks[docs].tobytes(), _pack(back), _pack(place), _short(gram[take]), _short(phrase[take])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)], names=["bucket", "ids", "marks", "owner", "places", "gram", "phrase"])

    return run


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the one shuffle that they take."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for first, texts in _pieces(batch.column(1), PARSED * 8):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(list(map(mark, texts)), pa.int32()), pa.array([press.compress(t) for t in texts], pa.binary())], names=["id", "mark", "text"])


SPANS = "id long, mark int, spans binary"
SETTLED_NAMES = ["id", "mark", "spans", "at", "gram", "many"]


def _ranges(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(id, mark, spans) once for each: its ranges of bytes as pairs of numbers, those that meet joined."""
    if not len(ids):
        return pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())
    order = np.lexsort((start, marks, ids))
    ids, marks, start, stop = ids[order], marks[order], start[order].astype(np.int32), stop[order].astype(np.int32)
    own = np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    new = np.flatnonzero(own | np.concatenate([[True], start[1:] > stop[:-1]]))  # all are of one length, or runs apart
    pairs = np.stack([start[new], np.maximum.reduceat(stop, new)], axis=1)
    first = np.flatnonzero(own[new])
    offsets = np.append(first, len(new)).astype(np.int32) * 8
    spans = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(pairs).tobytes())])
    return pa.array(ids[new][first]), pa.array(marks[new][first]), spans


def _settle(buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gone(ids, marks, at):
            rows = _ranges(ids, marks, at - BEFORE, at + LENGTH)
            n = len(rows[0])
            return pa.RecordBatch.from_arrays([*rows, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=SETTLED_NAMES)

        def ask(ids, marks, at, gram, many):
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), pa.nulls(len(ids), pa.binary()), pa.array(at), pa.array(gram), pa.array(many)], names=SETTLED_NAMES)

        for g in groups_of(batches, 1):
            cols = [g.column(k).to_pylist() for k in range(1, 7)]
            ids, marks = [], []
            for a, b, c in zip(cols[0], cols[1], cols[2], strict=True):
                owner = _unpack(c)
                ids.append(_unpack(a)[owner])
                marks.append(np.frombuffer(b, np.int32)[owner])
            ids, marks = np.concatenate(ids), np.concatenate(marks)
            at = np.concatenate([_unpack(x).astype(np.int32) for x in cols[3]])
            if g.column(0)[0].as_py() >= buckets:
                for k in range(0, len(ids), SETTLED):
                    yield gone(ids[k : k + SETTLED], marks[k : k + SETTLED], at[k : k + SETTLED])
                continue
            gram, phrase = _long(cols[4]), _long(cols[5])
            del cols
            # all phrases of a trigger lie in one part of the bucket
            split = -(-len(ids) // SETTLED)
            part = (gram >> np.uint64(20)) % np.uint64(split)
            for k in range(split):
                some = np.flatnonzero(part == k) if split > 1 else slice(None)
                yield from settle(*(x[some] for x in (ids, marks, at, gram, phrase)), gone, ask)

    def settle(ids, marks, at, gram, phrase, gone, ask) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, phrase, gram))
        ids, marks, at, gram, phrase = (x[order] for x in (ids, marks, at, gram, phrase))
        if not len(ids):
            return
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_phrase = new_gram | np.concatenate([[True], phrase[1:] != phrase[:-1]])
        first = np.flatnonzero(new_phrase)
        least = ids[first][np.cumsum(new_phrase) - 1]
        covered = ids > least
        if covered.any():
            yield gone(ids[covered], marks[covered], at[covered])
        # triggers of several phrases whose least documents differ
        which = np.cumsum(new_gram) - 1
        low, high = np.full(which[-1] + 1, np.iinfo(np.int64).max), np.full(which[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, which[first], ids[first])
        np.maximum.at(high, which[first], ids[first])
        apart = _in(hot, gram)
        left = ~covered & ((low < high)[which] | apart)
        if left.any():
            many = apart | (np.bincount(which[left], minlength=which[-1] + 1) > SORTED)[which]
            yield ask(ids[left], marks[left], at[left], gram[left].view(np.int64), many[left])

    return run


def _rows_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows, as a row here becomes many Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            yield batch.slice(k, most)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # id, mark, text, asked: places and grams of one document
    for batch in _rows_of(batches, FETCHED):
        rows: list[tuple] = []
        for i, m, text, asked in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = zstandard.ZstdDecompressor().decompress(text)
            for a in asked:
                t = a["at"]
                s = max(t - BEFORE, 0)
                rows.append((a["gram"], i, m, t, s, text[s : t + LENGTH]))
            if len(rows) > 50_000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["gram", "id", "mark", "at", "start", "phrase"])


def _order(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each text among the distinct ones, leading bytes that each distinct one shares with the one before it).

    Texts of up to ``width`` bytes, sorted as strings; shorter ones end in a symbol below all bytes.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    table = np.zeros((len(texts), width), np.uint16)
    table[np.arange(width) < sizes[:, None]] = flat.astype(np.uint16) + 1
    order = np.lexsort(table.T[::-1])
    t = table[order]
    differ = t[1:] != t[:-1]
    new = np.concatenate([[True], differ.any(axis=1)])
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.cumsum(new) - 1
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return rank, np.concatenate([[0], shared])[new]


def owned(ids: np.ndarray, lefts: list[bytes], rights: list[bytes], gram: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the occurrence, bytes before its trigger) of each string of the match length that a lesser document owns.

    ``lefts`` are the bytes before a trigger, last one first: in that order stand the dictionary's suffixes that end in the trigger.
    ``rights`` follow it: in their order stand the suffixes of the parse that begin with it. A string takes some bytes of
    either, so its class is an interval of the one order and one of the other, by the bytes that neighbours share.
    """
    left, left_shared = _order(lefts, BEFORE)
    right, right_shared = _order(rights, BEFORE)
    left_size, right_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (lefts, rights))
    group = np.zeros(len(ids), np.int64) if gram is None else np.unique(gram, return_inverse=True)[1]
    index, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(BEFORE + 1):
        some = np.flatnonzero((left_size >= k) & (right_size >= BEFORE - k))
        if len(some) < 2:
            continue
        a = (np.cumsum(left_shared < k) if k else np.zeros(len(left_shared), np.int64))[left[some]]
        b = (np.cumsum(right_shared < BEFORE - k) if k < BEFORE else np.zeros(len(right_shared), np.int64))[right[some]]
        order = np.lexsort((ids[some], b, a, group[some]))
        a, b, g, who = a[order], b[order], group[some][order], ids[some][order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (g[1:] != g[:-1])])
        hit = some[order[who > who[np.flatnonzero(new)][np.cumsum(new) - 1]]]
        index.append(hit)
        before.append(np.full(len(hit), k))
    index, before = np.concatenate(index), np.concatenate(before)
    order = np.lexsort((-before, index))
    return index[order], before[order]


def _sides(at: np.ndarray, starts: np.ndarray, phrases: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    places = (at - starts).tolist()
    return [p[:k][::-1] for p, k in zip(phrases, places, strict=True)], [p[k + GRAM :] for p, k in zip(phrases, places, strict=True)]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # gram, id, mark, at, start, phrase: sorted by gram, so groups may be put together up to a size
    def work(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        gram, ids, marks, at, starts = (t.column(k).to_numpy() for k in range(5))
        index, before = owned(ids, *_sides(at, starts, t.column(5).to_pylist()), gram)
        start = at[index].astype(np.int64) - before
        return pa.RecordBatch.from_arrays(list(_ranges(ids[index], marks[index], start, start + LENGTH)), names=SETTLED_NAMES[:3])

    held: list[pa.Table] = []
    size = 0
    for g in groups_of(batches, 1):
        held.append(g)
        size += g.num_rows
        if size >= SORTED:
            yield work(held)
            held, size = [], 0
    if held:
        yield work(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings around triggers that have too many different phrases for one task, each under a digest of its own."""
    # gram, id, mark, at, start, phrase
    for batch in _rows_of(batches, DIGESTED):
        rows: list[tuple] = []
        for gram, i, m, t, s, p in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            rows += [(xxhash.xxh3_128_digest(p[k : k + LENGTH], seed=gram & 0xFFFFFFFF), i, m, s + k) for k in range(max(0, t - BEFORE - s), min(t - s, len(p) - LENGTH) + 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["string", "id", "mark", "start"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # id, mark, start: sorted by id and mark, so a document has a row, and one more where a batch ends within it
    for batch in batches:
        ids, marks, start = (batch.column(k).to_numpy() for k in range(3))
        yield pa.RecordBatch.from_arrays(list(_ranges(ids, marks, start, start + LENGTH)), names=SETTLED_NAMES[:3])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # id, text, lists of spans
    for batch in batches:
        n, removed, spans, digest = [], [], [], []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = zstandard.ZstdDecompressor().decompress(text)
            size = len(text)
            n.append(size)
            if not ranges:
                removed.append(0)
                spans.append(0)
                digest.append(hashlib.sha256(text).hexdigest())
                continue
            r = np.frombuffer(b"".join(ranges), np.int32).reshape(-1, 2).astype(np.int64)
            r = r[np.argsort(r[:, 0], kind="stable")]
            s, e = np.maximum(r[:, 0], 0), np.minimum(np.maximum.accumulate(r[:, 1]), size)
            new = np.concatenate([[True], s[1:] > e[:-1]])
            first = np.flatnonzero(new)
            s, e = s[first], e[np.append(first[1:], len(e)) - 1]
            removed.append(int((e - s).sum()))
            spans.append(len(s))
            digest.append(hashlib.sha256(b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), size], strict=True))).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte goes that a 50-byte string covers which also starts in a document with a lesser id. Null texts count as empty;
    texts under 50 bytes keep all. Rows with a null id neither lose bytes nor own strings. Rows of one id never take
    from each other, and equal rows each get the same result. Ids of any type are compared in their own order. Strings
    are judged on the input. An empty table gives no rows. Other columns are not read.
    """
    if not integral(docs, id_col):
        return over_numbers(lambda df: remove_repeats(df, id_col, text_col), docs, id_col, [text_col], ["doc_id"])
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    known = rows.where("id is not null")
    hot = hot_triggers(known, parts)
    # the filter, which an inner join would add for itself, lets both joins share one shuffle
    small = known.mapInArrow(_shrink, "id long, mark int, text binary").where("id is not null and mark is not null")
    parsed = known.mapInArrow(_parse(parts, hot), "bucket int, ids binary, marks binary, owner binary, places binary, gram binary, phrase binary")
    # read by several branches below, which would each compute it again
    settled = written(parsed.repartition(parts * 2, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(parts, hot), f"{SPANS}, at int, gram long, many boolean"))

    def fetched(some: DataFrame) -> DataFrame:
        asked = some.groupBy("id", "mark").agg(F.collect_list(F.struct("at", "gram")).alias("asked")).withColumnsRenamed({"id": "i2", "mark": "m2"})
        return small.join(asked, (F.col("id") == F.col("i2")) & (F.col("mark") == F.col("m2"))).select("id", "mark", "text", "asked").mapInArrow(_fetch, "gram long, id long, mark int, at int, start int, phrase binary")

    ends = fetched(settled.where("gram is not null and not many")).repartition(parts * 2, "gram").sortWithinPartitions("gram").mapInArrow(_sort, SPANS)
    if settled.where("many").limit(1).count():
        strings = written(fetched(settled.where("many")).mapInArrow(_strings, "string binary, id long, mark int, start int"))
        least = strings.groupBy("string").agg(F.min("id").alias("least")).withColumnRenamed("string", "s2")
        # a key that is computed anew is shuffled anew, so that adaptive execution may split a string of many documents
        more = strings.withColumn("string", F.concat("string", F.lit(b""))).join(least, F.col("string") == F.col("s2")).where("id > least")
        # a document's strings meet before they are packed: one row for each document, however many tasks the strings came from
        more = more.select("id", "mark", "start").repartition(parts, "id", "mark").sortWithinPartitions("id", "mark")
        ends = ends.unionAll(more.mapInArrow(_packed, SPANS))
    covered = settled.where("gram is null").select("id", "mark", "spans")
    ranges = covered.unionAll(ends).groupBy("id", "mark").agg(F.collect_list("spans").alias("ranges"))
    joined = small.join(ranges.withColumnsRenamed({"id": "i2", "mark": "m2"}), (F.col("id") == F.col("i2")) & (F.col("mark") == F.col("m2")), "left").select("id", "text", "ranges")
    alone = rows.where("id is null").mapInArrow(_shrink, "id long, mark int, text binary").select("id", "text", F.lit(None).cast(joined.schema["ranges"].dataType).alias("ranges"))
    return joined.unionAll(alone).mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
