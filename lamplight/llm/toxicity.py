"""Toxicity by class-conditional Kneser-Ney models (operator 2).

Each class has a model of expressions: words and pairs of words, counted by the training documents that hold them, so that a
phrase repeated within one text counts once. A count loses the discount, and what that sets free falls back on the counts of
both classes together: an expression of few documents is scored alike by both, and one of up to ``DISCOUNT`` documents has
no say at all. The chance of a word after another is the pair's over the first word's; a pair that is not in the tables falls
back to its second word. Words outside the tables fall back to their characters: a Kneser-Ney model of each class (five
characters before each) over shared continuation counts, its evidence bounded.

A text's score compares the two log-likelihoods, length-normalised in two ways: over its three most telling words, and, for
what exceeds one nat, over all of its words. A logistic calibration of the two, fitted on a fold that its counts have
not seen, gives 0 to 1.

Counts come from all labelled training rows by distributed aggregates: over words, then pairs of words in the vocabulary,
and character n-grams, each under a 64-bit number of its own. All n-grams that end alike but for their first and last characters
meet in one task, which holds every count that their probabilities need. Log ratios (of n-grams, contexts, words and
pairs) are sorted tables that grow with the corpus, and in which what was not seen is not found. Up to ``HELD_RATIOS`` rows
of them are sent to all tasks. Of more than ``HOT_PAIRS`` pairs those of most documents are sent; each text settles with them what they
and its words can, and only words that a pair outside of them may make one of the most telling, or put above one nat, are rows that are
joined with the others. Larger tables of words stay in Spark: the words of each distinct text are joined with them, and
nothing of the model is gathered. All ways give a text the same two figures.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import Lookup, lean, shuffle_parts, slices, written

#: Characters before the predicted one, and the discount of their counts.
CONTEXT = 5
CHARACTER_DISCOUNT = 0.9
#: Documents that a word or a pair of words loses in each class.
DISCOUNT = 2
#: Weight of the characters' log ratio for words outside the tables, and its bound.
CHARACTERS_WEIGH = 0.5
CHARACTERS_SAY = 1.0
#: Words that tell most, and the log ratio from which a word adds to the text's share of telling ones.
TELLING = 3
PLAIN = 1.0
#: Labelled rows that fit the calibration (four weights and a constant), at most.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7
#: Words a task counts before it hands them on, and the longest piece of a run of letters that is a word.
HELD_WORDS = 200_000
KEPT_WORDS = 100_000
#: Words whose n-grams a task counts together, and n-grams that it rates together (whole contexts, so it may be more).
COUNTED_WORDS = 50_000
RATED_GRAMS = 200_000
LONGEST = 48
WORD = re.compile(r"\w{1,%d}" % LONGEST)
#: Bits of the filter of labelled ids that is sent to all tasks: 8 MB at any size.
FILTER_BITS = 1 << 26
#: Rows of log ratios (12 bytes each, 96 MB) that the driver gathers and sends to all tasks, for words and n-grams and again for pairs.
HELD_RATIOS = 1 << 23
#: Pairs that are sent to all tasks at most (48 MB); of more, those of the most documents.
HOT_PAIRS = 1 << 22
#: Pairs of words that a task holds before it hands them on.
HELD_PAIRS = 1_000_000
#: Rows of their counts that it hands on in a batch, which Spark holds whole.
HANDED = 50_000
#: Counts of a word or an n-gram: ordinary and toxic rows of fold 0, and of fold 2.
FOUR = ("p0", "t0", "p2", "t2")
NUMBER = {(0, 0): 0, (0, 1): 1, (2, 0): 2, (2, 1): 3}
#: Scale of the characters' evidence that the worker cache keeps as integers; the offset keeps them above 0.
SCALE, OFFSET = 1 << 16, 1 << 20


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(words: list[str]) -> tuple[np.ndarray, ...]:
    """For each predicted character of all words, the end included: (word's index, numbers of the n-gram, of its context, of the
    n-gram without its first character, of that one's context)."""
    pad = "\x02" * CONTEXT
    codes = np.frombuffer("".join(f"{pad}{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes + CONTEXT + 1)
    starts = np.cumsum(sizes + CONTEXT + 1) - (sizes + CONTEXT + 1)
    at = np.flatnonzero(np.arange(len(codes)) - starts[owner] >= CONTEXT)
    short = np.full(len(at), 7, np.uint64)
    for k in range(CONTEXT - 1, 0, -1):
        short = _mix(short, codes[at - k])
    long = _mix(short, codes[at - CONTEXT] + np.uint64(1 << 33))
    return owner[at], *(h.view(np.int64) for h in (_mix(long, codes[at] + np.uint64(1 << 34)), long, _mix(short, codes[at] + np.uint64(1 << 35)), short))


def _none(kind) -> np.ndarray:
    return field(default_factory=lambda: np.zeros(0, kind))


@dataclass
class Model:
    grams: np.ndarray  # numbers of the n-grams seen, in order
    ratio: np.ndarray  # of each: log P(toxic) - log P(ordinary)
    contexts: np.ndarray  # numbers of the contexts seen, in order
    unseen: np.ndarray  # of each: the same for any character not seen after it
    words: np.ndarray = _none(np.int64)  # numbers of the vocabulary's words, in order
    word_ratio: np.ndarray = _none(np.float32)
    pairs: np.ndarray = _none(np.int64)  # numbers of the pairs of words, in order
    pair_ratio: np.ndarray = _none(np.float32)
    cold: np.ndarray = _none(np.uint32)  # a filter of the pairs that are not here but elsewhere
    high: np.ndarray = _none(np.uint32)  # and of those of them whose log ratio is above 0
    most: float = 0.0  # the largest log ratio of theirs

    def score(self, words: list[str]) -> np.ndarray:
        """Log ratios of words by their characters."""
        if not words:
            return np.zeros(0)
        owner, g, h, _, _ = grams(words)
        r = found(self.grams, self.ratio, g, np.nan)
        miss = np.isnan(r)
        r[miss] = found(self.contexts, self.unseen, h[miss], 0.0)
        return np.bincount(owner, r, len(words))

    def place(self, words: list[str]) -> list[int]:
        """Place of each word in the vocabulary; for other words, that many and more: what their characters say."""
        at = places(self.words, numbers(words))
        other = np.flatnonzero(at < 0)
        said = np.clip(self.score([words[k] for k in other.tolist()]) * CHARACTERS_WEIGH, -CHARACTERS_SAY, CHARACTERS_SAY)
        at[other] = len(self.words) + OFFSET + np.rint(said * SCALE).astype(np.int64)
        return at.tolist()

    def ratios(self, at: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log ratio of each word of texts laid end to end, given its place; ``begins`` marks the first words of texts."""
        return self.judged(at, begins)[0]

    def judged(self, at: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, and which words of the vocabulary come after another one in a pair that is not in the table."""
        n = len(self.words)
        known = at < n
        r = np.empty(len(at))
        r[known] = self.word_ratio[at[known]]
        r[~known] = (at[~known] - n - OFFSET) / SCALE
        second = np.flatnonzero(known[1:] & known[:-1] & ~begins[1:]) + 1
        if len(second) and len(self.pairs):
            pair = found(self.pairs, self.pair_ratio, pair_numbers(self.words[at[second - 1]], self.words[at[second]]), np.nan)
            hit = ~np.isnan(pair)
            r[second[hit]] = pair[hit] - self.word_ratio[at[second[hit] - 1]]
            second = second[~hit]
        return r, second


def numbers(words: list[str]) -> np.ndarray:
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)).view(np.int64)


def pair_numbers(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(_mix(np.full(len(first), 11, np.uint64), first.view(np.uint64)), second.view(np.uint64)).view(np.int64)


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted in ``keys``, which are in order; -1 where it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def expression_ratio(plain: Column, toxic: Column, totals: list[int]) -> Column:
    """log P(toxic) - log P(ordinary) of an expression; null where neither class keeps a document after the discount.

    ``totals`` are the sums over all expressions: documents of ordinary ones, of toxic ones, the same after the discount. A class gives an
    expression what the discount leaves of its documents, and the share that discounts set free times its part in all documents. What else
    a class's discounts set free is for expressions outside the tables, which this does not score.
    """
    every = float(totals[0] + totals[1]) or 1.0
    shared = (plain + toxic) * F.lit((1 - (totals[2] + totals[3]) / every) / every)
    log = [F.log(F.greatest(F.greatest(n - DISCOUNT, F.lit(0)) / F.lit(float(total or 1)) + shared, F.lit(1e-300))) for n, total in ((toxic, totals[1]), (plain, totals[0]))]
    return F.when((plain > DISCOUNT) | (toxic > DISCOUNT), log[0] - log[1]).cast("float")


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    """The values of the wanted keys; ``keys`` are in order."""
    some, back = np.unique(wanted, return_inverse=True)
    out = np.full(len(some), otherwise)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
        hit = keys[at] == some
        out[hit] = values[at[hit]]
    return out[back]


def estimate(g: np.ndarray, h: np.ndarray, low: np.ndarray, lowh: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> Model:
    """Interpolated Kneser-Ney: class counts on top, pooled continuation counts below, uniform at the bottom.

    ``g`` are distinct, and all n-grams of a ``lowh`` are there; others have no part in its probabilities.
    """
    live = toxic + plain > 0
    g, h, low, lowh, toxic, plain = (x[live] for x in (g, h, low, lowh, toxic, plain))
    contexts, h = np.unique(h, return_inverse=True)
    _, first, low = np.unique(low, return_index=True, return_inverse=True)
    lowh = np.unique(lowh, return_inverse=True)[1]
    kinds = np.bincount(low).astype(float)  # distinct left extensions of the shorter n-gram
    every = np.bincount(lowh[first], kinds)
    branch = np.bincount(lowh[first])
    base = 1 / 256
    shared = (np.maximum(kinds[low] - CHARACTER_DISCOUNT, 0) + CHARACTER_DISCOUNT * branch[lowh] * base) / every[lowh]
    logs, left = [], []
    for n in (toxic, plain):
        total = np.bincount(h, n, len(contexts))
        types = np.bincount(h, n > 0, len(contexts))
        mass = np.where(total > 0, CHARACTER_DISCOUNT * types / np.maximum(total, 1), 1.0)
        p = np.where(total[h] > 0, np.maximum(n - CHARACTER_DISCOUNT, 0) / np.maximum(total[h], 1), 0) + mass[h] * shared
        logs.append(np.log(np.maximum(p, 1e-12)))
        left.append(np.log(mass))
    order = np.argsort(g)
    return Model(g[order], (logs[0] - logs[1])[order].astype(np.float32), contexts, (left[0] - left[1]).astype(np.float32))


def whole_contexts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns of batches sorted by ``lowh``, about ``most`` rows at once; a ``lowh`` never splits."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        lowh = batch.column("lowh").to_numpy()
        stop = int(np.searchsorted(lowh, lowh[-1]))
        if stop or len(held) > 1 and held[-2].column("lowh")[-1].as_py() != lowh[-1]:
            yield _columns([*held[:-1], batch.slice(0, stop)])
            held, rows = [batch.slice(stop)], batch.num_rows - stop
    if rows:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {k: table.column(k).to_numpy() for k in table.column_names}


@lean
def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Log ratios of n-grams and contexts by the model and by the one of fold 0 alone (null where that has not seen them)."""
    for a in whole_contexts(batches, RATED_GRAMS):
        uniq, where, back = np.unique(a["g"], return_index=True, return_inverse=True)
        key = [uniq, *(a[k][where] for k in ("h", "low", "lowh"))]
        n = {k: np.bincount(back, a[k]).astype(np.int64) for k in FOUR}
        both = estimate(*key, n["t0"] + n["t2"], n["p0"] + n["p2"])
        first = estimate(*key, n["t0"], n["p0"])
        for seen, keys, values, some, theirs in ((True, both.grams, both.ratio, first.grams, first.ratio), (False, both.contexts, both.unseen, first.contexts, first.unseen)):
            early = found(some, theirs, keys, np.nan).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), seen, np.int8)), pa.array(keys), pa.array(values), pa.array(early, mask=np.isnan(early))], names=["kind", "key", "both", "first"])


def _kept(number):
    """Rows of ``FOUR`` that keep a document after the discount, under their number, and a row of totals without one."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(8, np.int64)
        for batch in batches:
            n = np.stack([batch.column(k).to_numpy() for k in FOUR])
            both = np.stack([n[0] + n[2], n[1] + n[3]])
            totals += np.concatenate([both.sum(axis=1), np.maximum(both - DISCOUNT, 0).sum(axis=1), n[:2].sum(axis=1), np.maximum(n[:2] - DISCOUNT, 0).sum(axis=1)])
            live = np.flatnonzero((both > DISCOUNT).any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(number(batch.column(0).take(pa.array(live)))), *(pa.array(x[live]) for x in n), *[pa.nulls(len(live), pa.int64())] * 4], names=["key", *FOUR, *MORE])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([x]) for x in totals)], names=["key", *FOUR, *MORE])

    return run


MORE = ("e4", "e5", "e6", "e7")
KEPT = "key long, " + ", ".join(f"{c} long" for c in (*FOUR, *MORE))


def expressions(kept: DataFrame) -> DataFrame:
    """(kind 2, key, both, first): log ratios by the model and by fold 0 alone, from the rows of ``_kept``."""
    totals = [int(x or 0) for x in kept.where("key is null").agg(*[F.sum(c) for c in (*FOUR, *MORE)]).first()]
    p0, t0, p2, t2 = (F.col(c) for c in FOUR)
    return kept.where("key is not null").select(
        F.lit(2).cast("byte").alias("kind"), "key", expression_ratio(p0 + p2, t0 + t2, totals[:4]).alias("both"), expression_ratio(p0, t0, totals[4:]).alias("first")
    )


def gathered(rated: DataFrame) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For the model and that of fold 0 alone: (keys in order, log ratios) of contexts, n-grams and expressions."""
    table = rated.toArrow()
    kind, key, both, first = (table.column(k).to_numpy() for k in ("kind", "key", "both", "first"))
    order = np.argsort(key)
    out = []
    for values in (both, first):
        some = order[~np.isnan(values[order])]
        out.append([(key[x], values[x]) for x in (some[kind[some] == k] for k in range(3))])
    return out


def features(texts: list[str], model: Model, cache: Lookup) -> np.ndarray:
    """Rows of length-normalised log ratios: of the three most telling words, and of all that exceeds PLAIN over all words."""
    flat, n, starts, begins = laid(texts)
    out = np.zeros((len(texts), 2))
    if not flat:
        return out
    some = n > 0
    r = model.ratios(cache.numbers(flat), begins)
    out[some, 1] = np.add.reduceat(np.maximum(r - PLAIN, 0), starts) / n[some]
    best = most_telling(r, starts, np.repeat(np.arange(len(starts)), n[some]))
    out[some, 0] = np.where(np.isfinite(best), best, 0.0).sum(axis=0) / np.minimum(n[some], TELLING)
    return out


def laid(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts end to end; of each text how many, where those that have some begin, and marks there."""
    lists = [WORD.findall(t.lower()) for t in texts]
    flat = [w for x in lists for w in x]
    n = np.array([len(x) for x in lists], np.int64)
    starts = (np.cumsum(n) - n)[n > 0]
    begins = np.zeros(len(flat), bool)
    begins[starts] = True
    return flat, n, starts, begins


def most_telling(r: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The TELLING largest of each text, a row for each place; -inf where there are fewer. ``r`` loses them."""
    out = np.empty((TELLING, len(starts)))
    for best in out:
        np.maximum.reduceat(r, starts, out=best)
        hit = np.flatnonzero(r == best[owner])
        r[hit[np.unique(owner[hit], return_index=True)[1]]] = -np.inf
    return out


def _figures(shared, packed: bool):
    """What a text's words and the pairs sent tell of it, and the words that other pairs may make tell more. uid, key, z or text

    A word after another whose pair may be elsewhere has the ratio of its own or of that pair. It counts for nothing if neither can exceed
    PLAIN, nor the last of the most telling ones among the other words; else it is handed on with both of its words' ratios.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = _cache(model)
        for batch in batches:
            for part in slices(batch, 2, zstandard.frame_content_size if packed else None):
                flat, n, starts, begins = laid(_texts(part, 2) if packed else part.column(2).to_pylist())
                if not flat:
                    continue
                owner = np.repeat(np.arange(len(starts)), n[n > 0])
                at = cache.numbers(flat)
                r, missed = model.judged(at, begins)
                missed = missed[passes(model.cold, pair_numbers(model.words[at[missed - 1]], model.words[at[missed]]))]
                plain, before = r[missed], model.word_ratio[at[missed - 1]]
                pair = pair_numbers(model.words[at[missed - 1]], model.words[at[missed]])
                r[missed] = -np.inf
                over = np.add.reduceat(np.maximum(r - PLAIN, 0), starts)
                best = most_telling(r, starts, owner)
                more = np.maximum(plain, np.where(passes(model.high, pair), model.most, 0.0) - before) > np.minimum(best[-1], PLAIN)[owner[missed]]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[missed[more]], minlength=len(starts)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pair[more], plain[more].astype(np.float32), before[more])]
                rows = part.take(pa.array(np.flatnonzero(n > 0)))
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(n[n > 0]), pa.array(over), *map(pa.array, best), *lists], names=["uid", "key", "n", "over", *BEST, "pair", "plain", "before"])

    return run


#: A pair's place in a filter are the upper bits of its number, which are mixed well.
UPPER = 64 - (FILTER_BITS.bit_length() - 1)


def passes(bits: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    at = pairs.view(np.uint64) >> np.uint64(UPPER)
    return (bits[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)


BEST = [f"b{k}" for k in range(TELLING)]


def _cache(model: Model) -> Lookup:
    return Lookup(model.place, most=KEPT_WORDS)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights with the constant last, scale of each feature) by ridge-penalised Newton steps."""
    scale = np.maximum(np.abs(x).max(axis=0, initial=1e-9), 1e-9) if len(x) else np.ones(x.shape[1])
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    if len(y) == 0 or y.min() == y.max():  # one class only, or none: a constant
        w[-1] = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return w, scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, scale


def apply_logistic(x: np.ndarray, w: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x / scale @ w[:-1] + w[-1], -30, 30)))


def fold(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 3


def place(id_column: Column) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(FILTER_BITS))


def filter_bits(places: DataFrame) -> np.ndarray:
    """A filter of at most FILTER_BITS that holds every place (column at); what is not among them passes it by chance alone."""
    table = places.groupBy(F.floor(F.col("at") / 32).cast("int").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[table.column("k").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return out


def _press(shared):
    """Ids that may have a label with their texts compressed, for the one shuffle that they take. id, text, place"""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, bits = zstandard.ZstdCompressor(level=3), shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(bits[at // 32] >> (at % 32).astype(np.uint32) & 1)))
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()], pa.binary())], names=["id", "z"])

    return run


def _texts(part: pa.RecordBatch, at: int) -> list[str]:
    back = zstandard.ZstdDecompressor()
    return [back.decompress(z).decode("utf-8", "surrogatepass") for z in part.column(at).to_pylist()]


@lean
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the documents of each kind that hold them. part, y, z"""
    seen: list[Counter] = [Counter() for _ in FOUR]

    def out() -> pa.RecordBatch:
        table: dict[str, list[int]] = {}
        for k, one in enumerate(seen):
            for w, n in one.items():
                table.setdefault(w, [0, 0, 0, 0])[k] = n
            one.clear()
        cols = np.array(list(table.values()), np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(table.keys(), pa.string()), *(pa.array(cols[:, k]) for k in range(4))], names=["word", *FOUR])

    for batch in batches:
        for part in slices(batch, 2, zstandard.frame_content_size):
            for p, y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _texts(part, 2), strict=True):
                seen[NUMBER[p, y]].update(set(WORD.findall(t.lower())))
            if sum(map(len, seen)) > HELD_WORDS:
                yield out()
    yield out()


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character n-grams of words with their counts."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        held.clear()
        owner, g, h, low, lowh = grams(part.column(0).to_pylist())
        uniq, where, back = np.unique(g, return_index=True, return_inverse=True)
        sums = [np.bincount(back, part.column(k).to_numpy()[owner]).astype(np.int64) for k in FOUR]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (uniq, h[where], low[where], lowh[where], *sums)], names=["g", "h", "low", "lowh", *FOUR])

    for batch in batches:
        for start in range(0, batch.num_rows, COUNTED_WORDS):
            held.append(batch.slice(start, COUNTED_WORDS))
            if sum(x.num_rows for x in held) >= COUNTED_WORDS:
                yield out()
    if held:
        yield out()


def _pairs(shared):
    """Pairs of vocabulary words that follow each other, with the documents of each kind that hold them. part, y, z"""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        n = len(vocabulary)
        cache = Lookup(lambda ws: np.where((at := places(vocabulary, numbers(ws))) < 0, n, at).tolist(), most=KEPT_WORDS)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, kinds = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys)
            keys, kinds = keys[order], kinds[order]
            del order
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            starts = np.append(np.flatnonzero(new), len(keys))
            for at in range(0, len(starts) - 1, HANDED):
                some = starts[at : at + HANDED + 1]
                part = kinds[some[0] : some[-1]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[some[:-1]]), *(pa.array(np.add.reduceat((part == k).astype(np.int64), some[:-1] - some[0])) for k in range(4))], names=["g", *FOUR])

        for batch in batches:
            for part in slices(batch, 2, zstandard.frame_content_size):
                lists = [WORD.findall(t.lower()) for t in _texts(part, 2)]
                flat = [w for x in lists for w in x]
                if len(flat) < 2:
                    continue
                owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                at = cache.numbers(flat)
                second = np.flatnonzero((at[1:] < n) & (at[:-1] < n) & (owner[1:] == owner[:-1])) + 1
                key, who = pair_numbers(vocabulary[at[second - 1]], vocabulary[at[second]]), owner[second]
                order = np.lexsort((key, who))
                key, who = key[order], who[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
                kind = np.array([NUMBER[x] for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int8)
                held.append((key[new], kind[who[new]]))
                if sum(len(x) for x, _ in held) > HELD_PAIRS:
                    yield from out()
        if held:
            yield from out()

    return run


@lean
def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their numbers, each at least once. z"""
    seen: set[str] = set()

    def out() -> pa.RecordBatch:
        words = list(seen)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(numbers(words)), pa.array(words, pa.string())], names=["w", "word"])

    for batch in batches:
        for part in slices(batch, 0, zstandard.frame_content_size):
            for t in _texts(part, 0):
                seen.update(WORD.findall(t.lower()))
            if len(seen) > HELD_WORDS:
                yield out()
    yield out()


@lean
def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams and contexts of words. w, word"""
    for batch in batches:
        for k in range(0, batch.num_rows, 2_000):
            part = batch.slice(k, 2_000)
            owner, g, h, _, _ = grams(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(g), pa.array(h)], names=["w", "g", "h"])


@lean
def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a text: the number of the word, of the one before it (null at the start), of the pair. key, z"""
    for batch in batches:
        for part in slices(batch, 1, zstandard.frame_content_size):
            lists = [WORD.findall(t.lower()) for t in _texts(part, 1)]
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            w = numbers([x for one in lists for x in one])
            if not len(w):
                continue
            start = np.concatenate([[True], owner[1:] != owner[:-1]])
            before = np.concatenate([w[:1], w[:-1]])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(w), pa.array(before, mask=start), pa.array(pair_numbers(before, w), mask=start)], names=["key", "w", "before", "pair"])


def _anew(column: str) -> Column:
    """A key that is computed anew is shuffled anew, so that adaptive execution may split the rows of a frequent one."""
    return F.shiftleft(column, 0).alias(column)


def spread_features(texts: DataFrame, tables: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """(key, a, b): the figures of ``features`` for texts ``(key, z)`` with distinct keys, by joins; texts without words have no row.

    ``tables`` has kind, key and log ratios in column ``value``, ``pairs`` has key and ``value``. A word gets its ratio once for
    the whole corpus; then the rows of words are joined with words, with pairs and with the words before them.
    """

    def kind(k: int, name: str) -> DataFrame:
        return tables.where((F.col("kind") == k) & F.col(value).isNotNull()).select(F.col("key").alias(name), F.col(value).cast("double").alias(f"of_{name}"))

    types = written(texts.select("z").mapInArrow(_distinct, "w long, word string").groupBy("w").agg(F.min("word").alias("word")))
    rated = types.select("w").join(kind(2, "w"), "w")
    other = types.join(rated, "w", "left_anti").mapInArrow(_word_grams, "w long, g long, h long")
    other = other.join(kind(1, "g"), "g", "left").join(kind(0, "h"), "h", "left").groupBy("w").agg(F.sum(F.coalesce("of_g", "of_h", F.lit(0.0))).alias("said"))
    said = F.rint(F.greatest(F.least(F.col("said") * CHARACTERS_WEIGH, F.lit(CHARACTERS_SAY)), F.lit(-CHARACTERS_SAY)) * SCALE) / SCALE
    say = written(rated.unionAll(other.select("w", said)).withColumnRenamed("of_w", "r"))
    rows = texts.select("key", "z").mapInArrow(_placed, "key binary, w long, before long, pair long")
    rows = rows.select("key", _anew("w"), "before", "pair").join(say, "w")
    two = pairs.where(F.col(value).isNotNull()).select(F.col("key").alias("pair"), F.col(value).cast("double").alias("of_pair"))
    rows = written(rows.select("key", "r", "before", _anew("pair")).join(two, "pair", "left").select("key", "r", "before", "of_pair"))
    # only words after another that a pair is known of need the ratio of that one
    alone = rows.where("of_pair is null").select("key", "r")
    after = rows.where("of_pair is not null").select("key", "of_pair", _anew("before")).join(say.select(F.col("w").alias("before"), F.col("r").alias("first")), "before")
    every = alone.unionAll(after.select("key", (F.col("of_pair") - F.col("first")).alias("r")))
    told = F.aggregate(F.slice(F.sort_array(F.collect_list("r"), asc=False), 1, TELLING), F.lit(0.0), lambda x, y: x + y)
    return every.groupBy("key").agg((told / F.least(F.count("*"), F.lit(TELLING))).alias("a"), (F.sum(F.greatest(F.col("r") - PLAIN, F.lit(0.0))) / F.count("*")).alias("b"))


def _spread_pairs(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(g, FOUR) of pairs whose words both are in ``vocabulary`` (column w), by joins."""
    kinds = [((F.col("part") == p) & (F.col("y") == y)).cast("long") for p, y in NUMBER]
    placed = rows.select(F.to_binary(F.concat_ws(":", "part", "y", F.monotonically_increasing_id()), F.lit("utf-8")).alias("key"), "z").mapInArrow(_placed, "key binary, w long, before long, pair long")
    once = placed.where("pair is not null").distinct().select("w", "before", "pair", F.split(F.col("key").cast("string"), ":").alias("k"))
    once = once.select("w", "before", "pair", F.col("k")[0].cast("int").alias("part"), F.col("k")[1].cast("int").alias("y"))
    counted = once.groupBy("pair", "w", "before").agg(*[F.sum(k).alias(c) for k, c in zip(kinds, FOUR, strict=True)])
    both = counted.join(vocabulary, "w", "left_semi").join(vocabulary.withColumnRenamed("w", "before"), "before", "left_semi")
    return both.groupBy(F.col("pair").alias("g")).agg(*[F.sum(c).alias(c) for c in FOUR])


@dataclass
class Spread:
    """A model whose tables stay in Spark."""

    tables: DataFrame  # kind, key, both, first
    pairs: DataFrame  # kind, key, both, first

    def features(self, texts: DataFrame, value: str = "both") -> DataFrame:
        return spread_features(texts, self.tables, self.pairs, value)


@dataclass
class Split:
    """A model that is sent to all tasks but for the pairs of few documents, which stay in Spark."""

    models: dict  # both, first: a broadcast model with the pairs of many documents
    cold: DataFrame  # kind, key, both, first of the others

    def features(self, texts: DataFrame, value: str = "both") -> DataFrame:
        """(key, a, b): the figures of ``features`` for texts (key, z) or (key, text); texts without words have no row, equal keys one."""
        body = texts.columns[1]
        kinds = "uid long, key binary, n long, over double, " + ", ".join(f"{c} double" for c in BEST) + ", pair array<long>, plain array<float>, before array<float>"
        rows = written(texts.select(F.monotonically_increasing_id().alias("uid"), "key", body).mapInArrow(_figures(self.models[value], body == "z"), kinds))
        others = self.cold.where(F.col(value).isNotNull()).select(F.col("key").alias("pair"), F.col(value).cast("double").alias("of_pair"))
        opened = rows.select("uid", F.inline(F.arrays_zip("pair", "plain", "before"))).select("uid", _anew("pair"), "plain", "before")
        settled = opened.join(others, "pair", "left").select("uid", F.coalesce(F.col("of_pair") - F.col("before"), F.col("plain").cast("double")).alias("r"))
        largest = lambda x, n: F.slice(F.sort_array(x, asc=False), F.lit(1), n)
        more = settled.groupBy("uid").agg(largest(F.collect_list("r"), F.lit(TELLING)).alias("best"), F.sum(F.greatest(F.col("r") - PLAIN, F.lit(0.0))).alias("more"))
        tells = F.least("n", F.lit(TELLING)).cast("int")
        told = F.aggregate(largest(F.concat(F.array(*BEST), F.coalesce("best", F.array().cast("array<double>"))), tells), F.lit(0.0), lambda x, y: x + y)
        return rows.join(more, "uid", "left").select("key", (told / tells).alias("a"), ((F.col("over") + F.coalesce("more", F.lit(0.0))) / F.col("n")).alias("b")).dropDuplicates(["key"])


def parted(two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``_kept`` of at most HOT_PAIRS pairs, those of the most documents, and of the others; totals are in both."""
    n = sum((F.col(c) for c in FOUR[1:]), F.col(FOUR[0]))
    # numbers below 64 as they are, larger ones to a sixteenth
    two = two.withColumn("n", F.when(n < 64, n).otherwise(F.floor(F.log2(n) * 16)).cast("int"))
    rows, least = 0, None
    for k, size in sorted(map(tuple, two.where("key is not null").groupBy("n").count().collect()), reverse=True):
        rows += size
        if rows > HOT_PAIRS:
            break
        least = k
    hot = F.col("n") >= F.lit(least) if least is not None else F.lit(False)
    return two.where(F.col("key").isNull() | hot).drop("n"), two.where(F.col("key").isNull() | ~hot).drop("n")


def split_model(held: list, two: DataFrame) -> Split:
    """From what is gathered of words and n-grams, and the rows of ``_kept`` of all pairs."""
    spark = two.sparkSession
    hot, cold = (expressions(x) for x in parted(two))
    above = cold.where(F.greatest("both", "first") > 0)
    filters = [filter_bits(x.select(F.shiftrightunsigned("key", UPPER).alias("at"))) for x in (cold, above)]
    most = float(above.agg(F.max(F.greatest("both", "first"))).first()[0] or 0.0)
    models = [Model(*grams, *contexts, *words, *both, *filters, most) for (contexts, grams, words), (_, _, both) in zip(held, gathered(hot), strict=True)]
    return Split({name: spark.sparkContext.broadcast(m) for name, m in zip(("both", "first"), models, strict=True)}, cold)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model | Split | Spread, np.ndarray, np.ndarray]:
    """(model, calibration weights, their scales) from labelled rows whose fold is not 1.

    Null labels and null ids teach nothing; of repeated labels of an id the largest counts. Counts from folds 0 and 2
    together are the model; those of fold 0 alone score fold 2's rows to fit the calibration.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    marks = marks.where(fold(F.col("id")) != 1)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), place(F.col(id_col)).alias("place")).where("id is not null and text is not null").where(fold(F.col("id")) != 1)
    small = texts.mapInArrow(_press(spark.sparkContext.broadcast(filter_bits(marks.select(place(F.col("id")).alias("at"))))), f"id {kind}, z binary")
    # one join of the same kind at every size; its rows are read thrice below
    rows = written(small.join(marks.hint("merge"), "id").select(fold(F.col("id")).cast("int").alias("part"), "y", "z", "id"))
    four = ", ".join(f"{c} long" for c in FOUR)
    sums = [F.sum(c).alias(c) for c in FOUR]
    types = rows.select("part", "y", "z").mapInArrow(_words, f"word string, {four}").groupBy("word").agg(*sums)
    characters = types.mapInArrow(_count, f"g long, h long, low long, lowh long, {four}")
    rated = characters.repartition(shuffle_parts(spark), "lowh").sortWithinPartitions("lowh").mapInArrow(_ratios, "kind byte, key long, both float, first float")
    kept = types.mapInArrow(_kept(lambda words: numbers(words.to_pylist())), KEPT)
    # both from one shuffle of words
    every = [*FOUR, *MORE]
    table = written(
        rated.select("kind", "key", "both", "first", *[F.lit(None).cast("long").alias(c) for c in every])
        .unionAll(kept.select(F.lit(None).cast("byte"), "key", F.lit(None).cast("float"), F.lit(None).cast("float"), *every))
    )
    tables = table.where("kind is not null").select("kind", "key", "both", "first").unionAll(expressions(table.where("kind is null").select("key", *every)))
    small_enough = table.count() <= HELD_RATIOS
    # a pair that keeps a document after the discount has two words that do
    if small_enough:
        held = gathered(tables)
        vocabulary = spark.sparkContext.broadcast(held[0][2][0])
        counted = rows.select("part", "y", "z").mapInArrow(_pairs(vocabulary), f"g long, {four}").groupBy("g").agg(*sums)
    else:
        counted = _spread_pairs(rows, tables.where("kind = 2 and both is not null").select(F.col("key").alias("w")))
    two = written(counted.mapInArrow(_kept(lambda keys: keys.to_numpy()), KEPT))
    pairs = expressions(two)
    few = two.count() <= min(HELD_RATIOS, HOT_PAIRS)
    # a bounded sample of fold 2 in the order of a hash, taken by a threshold on it
    sample = rows.where("part = 2")
    total = sample.count()
    if total > CALIBRATION_ROWS:
        sample = sample.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * CALIBRATION_ROWS * 0.95 / total))
    if small_enough and few:
        model, first = (Model(*grams, *contexts, *words, *both) for (contexts, grams, words), (_, _, both) in zip(held, gathered(pairs), strict=True))
        shared = spark.sparkContext.broadcast(first)

        @lean
        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            cache = _cache(model)
            for batch in batches:
                for part in slices(batch, 1, zstandard.frame_content_size):
                    x = features(_texts(part, 1), model, cache)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "a", "b"])

        fit = sample.select("y", "z").mapInArrow(rate, "y int, a double, b double")
    else:
        model = split_model(held, two) if small_enough else Spread(tables, pairs)
        sample = written(sample.select("y", "z", F.unhex(F.sha2("z", 256)).alias("key")))
        fit = sample.select("y", "key").join(model.features(sample.dropDuplicates(["key"]), "first"), "key", "left")
        fit = fit.select("y", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    fit = fit.toArrow().to_pydict()
    x = np.array([fit[k] for k in "ab"], float).T.reshape(-1, 2)
    y = np.array(fit["y"], float)
    order = np.lexsort([*x.T, y])  # sums in one order, whatever order rows came in
    return model, *logistic(x[order], y[order])


@lean
def _press_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed under the digests of their own. text"""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in slices(batch, 0):
            texts = [t.encode("utf-8", "surrogatepass") for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(map(press.compress, texts), pa.binary())], names=["key", "z"])


def _rated(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, threshold: float, carry: list[str]) -> DataFrame:
    """doc_id, held_out, score, predicted and c0, c1, ... for the carried columns. A carried text is sent to Python once."""
    own = carry.index(text_col) if text_col in carry and docs.schema[text_col].dataType.simpleString() == "string" else None
    model, weights, scale = train(docs, labels, id_col, text_col, label_col)
    if not isinstance(model, Model):
        text = F.col(text_col).cast("string")
        key = F.unhex(F.sha2(text.cast("binary"), 256)).alias("key")
        if isinstance(model, Split):
            texts = docs.select(key, text.alias("text")).where("text <> ''")
        else:
            texts = written(docs.select(text.alias("text")).where("text <> ''").mapInArrow(_press_all, "key binary, z binary").dropDuplicates(["key"]))
        known = model.features(texts)
        z = (F.coalesce("a", F.lit(0.0)) / F.lit(float(scale[0]))) * F.lit(float(weights[0])) + (F.coalesce("b", F.lit(0.0)) / F.lit(float(scale[1]))) * F.lit(float(weights[1])) + F.lit(float(weights[2]))
        score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 1).alias("held_out"), key, *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
        rows = rows.join(known, "key", "left").select("doc_id", "held_out", score.alias("score"), *[f"c{k}" for k in range(len(carry))])
        return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[f"c{k}" for k in range(len(carry))])
    shared = docs.sparkSession.sparkContext.broadcast((model, weights, scale))
    names = ["doc_id", "held_out", "score", "predicted", *(f"c{k}" for k in range(len(carry)))]

    @lean
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w, scale = shared.value
        cache = _cache(model)
        for batch in batches:
            for part in slices(batch, 2):
                texts = [t or "" for t in part.column(2).to_pylist()]
                score = apply_logistic(features(texts, model, cache), w, scale)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *(part.column(2 if k == own else 3 + k) for k in range(len(carry)))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    kinds = "".join(f", c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    rows = docs.select(F.col(id_col).alias("a"), (fold(F.col(id_col)) == 1).alias("b"), F.col(text_col).cast("string").alias("t"), *[(F.lit(None) if k == own else F.col(c)).alias(f"x{k}") for k, c in enumerate(carry)])
    return rows.mapInArrow(rate, f"doc_id {kind}, held_out boolean, score double, predicted int{kinds}")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are learned from rows whose crc32(id as text) mod 3 is not 1; a null id counts as the empty string. Null
    and empty texts, or texts without word characters, score as a text that says nothing about either class. Without
    usable labels every score is 0.5; with labels of one class only it is near that class. Repeated rows get a row
    each, an empty table gives no rows, texts of any length are read whole, and labels, lang, source and id are no inputs.
    """
    return _rated(docs, labels, id_col, text_col, label_col, threshold, [])


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns without those that ``toxicity`` predicts as toxic."""
    rated = _rated(docs, labels, id_col, text_col, label_col, threshold, docs.columns)
    return rated.where("predicted = 0").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
