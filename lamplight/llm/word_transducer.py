"""BPE encoding and decoding through a minimal acyclic transducer of frequent words (operator 12).

Pass one finds frequent words by bounded summaries of the tasks. They are compiled, with the ids that the merge rules give
them, into a transducer: words share their beginnings and their ends, ids are written as early as they are certain. Its
arrays are one file in the shared folder; Spark brings it to every machine, where all Python workers map the same pages.
Pass two walks the distinct words of a few texts through it at once, and merges the words that it does not hold, exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lamplight.llm.common import SLICE_ROWS, checkpoint_dir, slices
from lamplight.llm.token_counts import SPECIAL, TOKENIZER, frequent, library, patterns, shown_bytes, whole

#: Words in the transducer, and the UTF-8 bytes of the longest: its file stays under 16 MB.
WORDS = 1 << 16
LONGEST_WORD = 64
#: From so many bytes on a word is merged on its own through a heap, shorter ones all at once.
HEAPED = 48
NEVER = 1 << 30
#: Rows and bytes of text whose words are looked up together.
PART_ROWS, PART_BYTES = 1200, 4 << 20


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    stop = np.cumsum(sizes)
    return np.repeat(starts - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)


class Merges:
    """The vocabulary and merge rules of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole_file = json.load(f)
        model, shown = whole_file["model"], shown_bytes()
        ids, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inside = np.array([ids[chr(shown[b])] for b in range(256)], np.int64)
        self.last = np.array([ids[chr(shown[b]) + end] for b in range(256)], np.int64)
        self.rules = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.specials = {t["content"]: t["id"] for t in whole_file["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.specials.values()]) + 1)
        for token, k in [*ids.items(), *self.specials.items()]:
            self.tokens[k] = token
        # the rules once more, in the order of their pairs: (left id, right id) to rank, and rank to the merged id
        pair = np.array([a << 32 | b for a, b in self.rules], np.int64)
        order = np.argsort(pair)
        self.pair, self.rank = pair[order], np.array([r for r, _ in self.rules.values()], np.int64)[order]
        self.merged = np.zeros(len(pairs) + 1, np.int64)
        self.merged[self.rank] = np.array([k for _, k in self.rules.values()], np.int64)[order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NEVER for those without a rule."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NEVER)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all words one after the other).

        In every round each word merges its adjacent pair of least rank, of those the leftmost, until none has a rule.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inside[text]
        ids[np.cumsum(sizes) - 1] = self.last[text[np.cumsum(sizes) - 1]]
        long = np.flatnonzero(sizes >= HEAPED)
        if len(long):
            at = np.cumsum(sizes) - sizes
            apart = {k: self._heaped(ids[at[k] : at[k] + sizes[k]].tolist()) for k in long.tolist()}
            short = np.flatnonzero(sizes < HEAPED)
            n, rest = self._rounds(ids[ranges(at[short], sizes[short])], sizes[short])
            every = np.zeros(len(words), np.int64)
            every[short] = n
            for k, got in apart.items():
                every[k] = len(got)
            out, to = np.zeros(int(every.sum()), np.int64), np.cumsum(every) - every
            out[ranges(to[short], n)] = rest
            for k, got in apart.items():
                out[to[k] : to[k] + len(got)] = got
            return every, out
        return self._rounds(ids, sizes)

    def _rounds(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(ids), NEVER)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            some = best >> 32 < NEVER
            # words without a rule are done and leave
            n = np.diff(np.append(starts, len(ids)))
            stays = np.repeat(some, n)
            done.append((word[~stays], ids[~stays]))
            at = best[some] & 0xFFFFFFFF
            ids[at] = self.merged[rank[at]]
            rank[at] = rank[at + 1]
            stays[at + 1] = False
            # places after the merged symbols have left
            now = np.cumsum(stays) - 1
            at = now[at]
            ids, word, rank = ids[stays], word[stays], rank[stays]
            marked = np.zeros(len(ids) + 1, bool)
            marked[at] = marked[at - 1] = True  # a first symbol marks the spare last place
            again = np.flatnonzero(marked[: max(len(ids) - 1, 0)])
            inside = word[again] == word[again + 1]
            rank[again[~inside]] = NEVER
            again = again[inside]
            rank[again] = self.ranks(ids[again], ids[again + 1])
            if len(ids):
                rank[-1] = NEVER
        which, out = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64), ids)
        return np.bincount(which, minlength=len(sizes)), out[np.argsort(which, kind="stable")]

    def _heaped(self, s: list[int]) -> list[int]:
        rules, n = self.rules, len(s)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, s[i], s[i + 1], r[1]) for i in range(n - 1) if (r := rules.get((s[i], s[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if s[i] != left or j < 0 or s[j] != right:
                continue  # one of the two has been merged since
            s[i], s[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := rules.get((new, s[k])):
                    heapq.heappush(heap, (r[0], i, new, s[k], r[1]))
            if (h := before[i]) >= 0 and (r := rules.get((s[h], new))):
                heapq.heappush(heap, (r[0], h, s[h], new, r[1]))
        return [x for x in s if x >= 0]


@lru_cache
def merges(path: str) -> Merges:
    return Merges(path)


def _shared(a: tuple, b: tuple) -> tuple:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return a[:n]


def compile_words(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The minimal acyclic transducer of words and their ids, as the bytes of its file.

    States are made from the longest common prefixes of the sorted words, ends first. A state hands the ids that all its
    words begin with to the arc before it; two states with the same arcs, ids and end are one.
    """
    order = sorted(words)
    register: dict[tuple, int] = {}
    pool: dict[tuple, int] = {(): 0}

    def state(key: tuple) -> int:
        return register.setdefault(key, len(register))

    def build(lo: int, hi: int, depth: int) -> tuple[int, tuple]:
        """(state, ids that all words of the range begin with) for words that share their first ``depth`` bytes."""
        final = None
        if len(order[lo]) == depth:
            final, lo = words[order[lo]], lo + 1
        arcs, common = [], final
        while lo < hi:
            label, at = order[lo][depth], lo
            while lo < hi and order[lo][depth] == label:
                lo += 1
            to, out = build(at, lo, depth + 1)
            arcs.append((label, to, out))
            common = out if common is None else _shared(common, out)
        n = len(common or ())
        arcs = tuple((label, to, pool.setdefault(out[n:], len(pool))) for label, to, out in arcs)
        return state((None if final is None else pool.setdefault(final[n:], len(pool)), arcs)), common or ()

    start, first = build(0, len(order), 0) if order else (state((None, ())), ())
    keys, to, out, ends = [], [], [], np.full(len(register), -1, np.int32)
    for (final, arcs), k in register.items():
        if final is not None:
            ends[k] = final
        for label, target, written in arcs:
            keys.append(k << 8 | label)
            to.append(target)
            out.append(written)
    first_at = pool.setdefault(first, len(pool))
    order_of = np.argsort(np.array(keys, np.int64))
    lengths = np.array([len(p) for p in pool], np.int32)
    parts = [
        np.array([start, first_at], np.int64), np.array(keys, np.int64)[order_of], np.array(to, np.int32)[order_of], np.array(out, np.int32)[order_of], ends,
        np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), np.array([i for p in pool for i in p], np.int32),
    ]
    head = np.array([x for p in parts for x in (len(p), p.itemsize)], np.int64)
    body = [p.tobytes() + bytes(-p.nbytes % 8) for p in parts]
    return head.tobytes() + b"".join(body)


class Lexicon:
    """A compiled transducer, mapped from its file."""

    def __init__(self, path: str):
        mapped = np.asarray(np.memmap(path, np.uint8, "r"))
        head = mapped[:112].view(np.int64).reshape(7, 2)
        parts, at = [], 112
        for n, size in head.tolist():
            parts.append(mapped[at : at + n * size].view(np.int64 if size == 8 else np.int32))
            at += n * size + -n * size % 8
        (self.start, self.first), self.keys, self.to, self.out, self.ends, self.pool_at, self.pool = parts[0].tolist(), *parts[1:]
        self.states = len(self.ends)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the transducer holds each word, its number of ids, ids of all words one after the other).

        All words take a step at a time; what their arcs write is put together at the end.
        """
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        state, live = np.full(n, self.start, np.int64), np.flatnonzero(sizes <= LONGEST_WORD)
        last = np.full(n, -1, np.int64)
        written = [(live, np.full(len(live), self.first, np.int64))]
        for step in range(LONGEST_WORD + 1):
            over = sizes[live] == step
            last[live[over]] = self.ends[state[live[over]]]
            live = live[~over]
            if not len(live) or not len(self.keys):
                break
            key = state[live] << 8 | text[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            live, arc = live[hit], arc[hit]
            state[live] = self.to[arc]
            some = self.out[arc] > 0
            written.append((live[some], self.out[arc[some]].astype(np.int64)))
        held = last >= 0
        ended = np.flatnonzero(last > 0)
        written.append((ended, last[ended]))
        which, what = (np.concatenate(x) for x in zip(*written))
        keep = held[which]
        which, what = which[keep], what[keep]
        order = np.argsort(which, kind="stable")
        which, what = which[order], what[order]
        lengths = (self.pool_at[what + 1] - self.pool_at[what]).astype(np.int64)
        count = np.bincount(which, lengths, minlength=n).astype(np.int64)
        return held, count, self.pool[ranges(self.pool_at[what].astype(np.int64), lengths)]


@lru_cache(maxsize=4)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def encode_words(path: str, lexicon: Lexicon, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, ids of all words one after the other): by the transducer, else by the merge rules."""
    held, n, ids = lexicon.encode(words)
    missed = np.flatnonzero(~held)
    if not len(missed):
        return n, ids
    more, others = merges(path).encode([words[k] for k in missed.tolist()])
    every = n.copy()
    every[missed] = more
    at = np.cumsum(every) - every
    out = np.zeros(int(every.sum()), np.int64)
    out[ranges(at[held], n[held])] = ids
    out[ranges(at[missed], more)] = others
    return every, out


@lru_cache
def _byte_of() -> dict[int, int]:
    return {c: b for b, c in shown_bytes().items()}


def split_text(path: str, text: str) -> list[str | bytes | int]:
    """Stretches of a text between white space, or its words as bytes and the ids of special strings in it, in order.

    A text with a character from U+0300 on is split by the library's normaliser and pre-tokeniser, as Python's rules differ
    there; its words come as bytes. Words of other texts never cross white space, so its stretches are split when they are new.
    """
    if not whole(text):
        return text.lower().split()
    lib, byte_of, specials = library(path), _byte_of(), merges(path).specials
    out: list[str | bytes | int] = []
    at = 0
    for m in [*SPECIAL.finditer(text), None]:
        segment = text[at : m.start() if m else len(text)]
        if segment:
            out += [w.translate(byte_of).encode("latin-1") for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(segment))]
        if m:
            out.append(specials[m.group()])
            at = m.end()
    return out


def encode_stretches(path: str, lexicon: Lexicon, stretches: list[str | bytes | int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each stretch, ids of all one after the other)."""
    split = patterns()[1].findall
    place: dict[str | bytes, int] = {}
    words: list[int] = []
    counts, special = np.ones(len(stretches), np.int64), []
    for k, x in enumerate(stretches):
        if isinstance(x, int):
            special.append(k)
            counts[k] = 0
        elif isinstance(x, bytes) or x.isalpha():
            words.append(place.setdefault(x, len(place)))
        else:
            found = split(x)
            counts[k] = len(found)
            words += [place.setdefault(w, len(place)) for w in found]
    n, ids = encode_words(path, lexicon, [w if isinstance(w, bytes) else w.encode() for w in place])
    at = np.array(words, np.int64)
    flat = ids[ranges((np.cumsum(n) - n)[at], n[at])]
    total = np.concatenate([[0], np.cumsum(n[at])])
    ends = np.cumsum(counts)
    sizes = total[ends] - total[ends - counts]
    if special:
        # a special string is one id between those of its neighbours
        flat = np.insert(flat, total[ends[special]], [stretches[k] for k in special])
        sizes[special] = 1
    return sizes, flat


def publish(spark: SparkSession, data: bytes) -> str:
    """Put a file into the shared folder and let Spark bring it to every machine; its name for ``SparkFiles``."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:32]}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode_bpe(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: (doc_id, ids array<int>), the ids that the ``tokenizers`` library gives the whole text.

    No special token is added, none is left out, nothing is cut or padded; special strings in a text become their ids as
    the library's default takes them. Null and empty texts have no ids. Repeated rows get a row each, null ids stay null,
    an empty table gives no rows, other columns are not read. ``tokenizer`` is the path of a word-end BPE file of the library; ``words`` bounds the transducer, which
    changes no id: a word that it does not hold is merged.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    hot = sorted({w.encode() for w in frequent(docs, text_col, words) if len(w.encode()) <= LONGEST_WORD})
    n, ids = merges(path).encode(hot)
    flat, ends = ids.tolist(), np.cumsum(n).tolist()
    name = publish(docs.sparkSession, compile_words({w: tuple(flat[e - k : e]) for w, e, k in zip(hot, ends, n.tolist())}))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(name)
        for batch in batches:
            for part in slices(batch, 1, rows=PART_ROWS, most=PART_BYTES):
                lists = [split_text(path, t) if t else [] for t in part.column(1).to_pylist()]
                flat: list[str | bytes | int] = []
                for x in lists:
                    flat += x
                place = {w: k for k, w in enumerate(dict.fromkeys(flat))}
                at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
                counts = [len(x) for x in lists]
                del lists, flat
                sizes, ids = encode_stretches(path, lexicon, list(place))
                n = sizes[at]
                out = ids[ranges((np.cumsum(sizes) - sizes)[at], n)]
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decode_bpe(encoded: DataFrame, tokenizer: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that the library's ``decode(ids, skip_special_tokens=False)`` gives: without a decoder in the file, the tokens joined by a space.

    Ids that the vocabulary does not have, and null ones, are left out as the library does; no ids give an empty text, a null list gives null.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    at = encoded.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merges(path).tokens
        known = len(tokens)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                lists = part.column(at)
                flat = lists.flatten()
                numbers = flat.to_numpy(zero_copy_only=False)
                if flat.null_count or len(numbers) and not 0 <= numbers.min() <= numbers.max() < known:
                    texts = [None if x is None else " ".join(tokens[i] for i in x if i is not None and 0 <= i < known) for x in lists.to_pylist()]
                else:
                    words = list(map(tokens.__getitem__, numbers.tolist()))
                    sizes = lists.value_lengths().to_pylist()
                    texts, at_word = [], 0
                    for n in sizes:
                        texts.append(None if n is None else " ".join(words[at_word : at_word + n]))
                        at_word += n or 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return encoded.mapInArrow(decode, StructType([*encoded.schema.fields, StructField(out_col, StringType())]))


def digests(ids: Column, decoded: Column) -> tuple[Column, Column, Column]:
    """(number of ids, SHA-256 of the ids in decimal joined by a space, SHA-256 of the decoded text)."""
    return F.size(ids).cast("long"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256), F.sha2(decoded, 256)
