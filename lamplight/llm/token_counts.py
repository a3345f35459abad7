"""Token counts by a two-tier lookup on the map side (operator 1).

A text's tokens are the sum of its pre-tokens' tokens. Pass one finds frequent pre-tokens: every task keeps a bounded
summary of what it reads and only summaries are combined. Their token counts are a broadcast hash table of fixed size.
Pass two looks every pre-token up there, and encodes misses in batches through a bounded cache that a Python worker keeps
from task to task. No pre-token is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import Lookup, slices

TOKENIZER = "word_bpe_49k.json"
#: Entries of the broadcast table (under 8 MB), of a task's summary and of what a task hands on.
HOT = 1 << 16
SUMMARY = 1 << 17
HANDED = 1 << 14
LIMIT = 2048
#: Texts of these characters alone take the fast path; there Python and the library agree on normal form, case, letters
#: and numbers. Any other text is encoded whole by the library.
FAST_BELOW = 0x300
SLOW = {*range(0x1C, 0x20), 0x130}
PLAIN = re.compile("[!-~]+")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


@lru_cache
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """(characters off the fast path, the pre-token pattern)."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in range(FAST_BELOW):
        if (k := unicodedata.category(chr(c))[0]) in kinds:
            kinds[k].append(re.escape(chr(c)))
    letters, numbers = "".join(kinds["L"]), "".join(kinds["N"])
    forced = re.compile("[^" + "".join(re.escape(chr(c)) for c in range(FAST_BELOW) if c not in SLOW) + "]")
    # contractions and classes of the vocabulary's pre-tokenizer (fixed values)
    return forced, re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")


def whole(text: str) -> bool:
    """Whether the library has to encode the text as a whole."""
    return bool(patterns()[0].search(text)) or "<|" in text and bool(SPECIAL.search(text))


@lru_cache
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache
def shown_bytes() -> dict[int, int]:
    """Byte to the character that stands for it in a byte-level vocabulary: itself where it is printable, else the next from 256."""
    out: dict[int, int] = {}
    for b in range(256):
        out[b] = b if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF else 256 + sum(k != v for k, v in out.items())
    return out


def lengths(path: str, words: list[str]) -> list[int]:
    """Token counts of pre-tokens, each by the library's model on its own."""
    tokenize, shown = library(path).model.tokenize, shown_bytes()
    return [len(tokenize(w if PLAIN.fullmatch(w) else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(shown))) for w in words]


_caches: dict[str, Lookup] = {}


def _cache(path: str, hot: dict[str, int]) -> Lookup:
    """The worker's cache; one of an earlier job serves as well, as a pre-token's count never changes."""
    if path not in _caches:
        _caches[path] = Lookup(lambda words: lengths(path, words), hot)
    return _caches[path]


def frequent(docs: DataFrame, text_col: str = "text", most: int = HOT) -> list[str]:
    """The most frequent pre-tokens over all texts, by the tasks' bounded summaries (a rare one may miss its place)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = patterns()[1]
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    if text and not whole(text):
                        seen.update(split.findall(text.lower()))
                if len(seen) > SUMMARY:  # lower all counts until few enough are left
                    cut = np.partition(np.fromiter(seen.values(), np.int64, len(seen)), -(SUMMARY // 2))[-(SUMMARY // 2)]
                    seen = Counter({w: n - cut for w, n in seen.items() if n > cut})
        top = seen.most_common(HANDED)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(summarise, "word string, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r[0] for r in top.collect()]


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal the library's on the whole text, without special tokens added; special strings in a text count as the
    library's default takes them. Null and empty texts have no bytes and no tokens. Repeated rows get a row each, null
    ids stay null, a text of any length is counted whole, an empty table gives no rows. Other columns are not read.
    ``tokenizer`` is the path of a word-end BPE file of the ``tokenizers`` library.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    words = frequent(docs, text_col, hot)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(words, lengths(path, words), strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = patterns()[1]
        cache = _cache(path, table.value)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                slow = [i for i, t in enumerate(texts) if whole(t)]
                apart = set(slow)
                lists = [[] if i in apart else split.findall(t.lower()) for i, t in enumerate(texts)]
                flat: list[str] = []
                for x in lists:
                    flat += x
                ends = np.cumsum([len(x) for x in lists])
                sums = np.concatenate([[0], np.cumsum(cache.numbers(flat))])
                n = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
                for i in slow:
                    n[i] = len(library(path).encode(texts[i], add_special_tokens=False))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
