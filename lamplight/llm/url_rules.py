"""URL filter by a bit-parallel wildcard automaton (operator 7).

A rule is a glob over the canonical URL: ``.host`` then a boundary symbol then the path. Its states are laid into 64-bit
words, rule after rule, and one Shift-And step per symbol moves all states of all rules: shift (with a carry between the
words), mask by the symbol, and keep the states that a wildcard holds. The step runs over a whole batch of URLs at once,
so Python's cost is one step per symbol position, not per URL and rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbol between host and path; bytes of a URL are below it.
EDGE = 256
STAR = -1
HOST_STAR = -2
#: URLs stepped together at most, and symbols of one URL block (rows times longest).
BLOCK_ROWS = 4096
BLOCK_CELLS = 4 << 20

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Automaton:
    masks: np.ndarray  # symbol x words: states that the symbol may enter
    loops: np.ndarray  # symbol x words: wildcard states that hold on the symbol
    first: np.ndarray  # words: first state of each rule
    final: list[tuple[int, int]]  # (word, bit) of each rule's last state
    words: int


def pattern(rule: str) -> list[int]:
    """``net/es/`` as symbols: any labels, a dot, the host, the boundary, the path's beginning."""
    host, _, rest = rule.partition("/")
    tail: list[int] = []
    for x in ("/" + rest).encode():
        tail.append(STAR if x == ord("*") else x)
    return [HOST_STAR, *(b"." + host.lower().encode()), EDGE, *tail]


def compile_rules(rules: Sequence[tuple[str, str]]) -> Automaton:
    """Pack all rules. A wildcard is no state of its own: it lets the state before it hold on any symbol it may take.

    Bit 0 of each rule is its start, which the leading host wildcard holds on every symbol of the host.
    """
    laid = [pattern(r) for _, r in rules]
    size = sum(1 + sum(x >= 0 for x in p) for p in laid)
    words = max(1, -(-size // 64))
    masks = np.zeros((EDGE + 1, words), np.uint64)
    loops = np.zeros((EDGE + 1, words), np.uint64)
    first = np.zeros(words, np.uint64)
    final = []
    at = 0

    def put(to: np.ndarray, rows, bit: int) -> None:
        to[rows, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    for p in laid:
        first[at // 64] |= np.uint64(1) << np.uint64(at % 64)
        for x in p:
            if x == HOST_STAR:
                put(loops, slice(0, EDGE), at)
            elif x == STAR:
                put(loops, slice(0, EDGE), at)
            else:
                at += 1
                put(masks, x, at)
        final.append((at // 64, at % 64))
        at += 1
    return Automaton(masks, loops, first, final, words)


def simulate(auto: Automaton, urls: list[list[int] | np.ndarray]) -> np.ndarray:
    """Which rules fit each URL (rows x rules): a rule fits once its last state has been entered at any prefix."""
    n = len(urls)
    lengths = np.array([len(u) for u in urls])
    wide = int(lengths.max(initial=0))
    grid = np.zeros((wide, n), np.int64)
    for i, u in enumerate(urls):
        grid[: len(u), i] = u
    state = np.broadcast_to(auto.first, (n, auto.words)).copy()
    seen = state & np.uint64(0)
    one, top = np.uint64(1), np.uint64(63)
    for j in range(wide):
        c = grid[j]
        shifted = state << one
        if auto.words > 1:
            shifted[:, 1:] |= state[:, :-1] >> top
        new = (shifted & ~auto.first & auto.masks[c]) | (state & auto.loops[c])
        live = lengths > j
        state = np.where(live[:, None], new, state)
        seen |= state
    fits = np.zeros((n, len(auto.final)), bool)
    for k, (w, b) in enumerate(auto.final):
        fits[:, k] = (seen[:, w] >> np.uint64(b)) & one == one
    return fits


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` with A-Z lower-cased; both empty where there is none."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    end = min((k for k in (rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains where the path starts with the rule's; of fitting rules the longest wins
    (the earlier of two as long). No fitting rule: rule is null and the verdict is ``default``. A null URL, or one
    without ``://``, has an empty host and path and fits none. Repeated rows are judged each, null ids stay null, an
    empty table gives no rows, and a URL of any length is read whole. Other columns are not read. No rules: all default.
    """
    rules = list(rules)
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), k))
    auto = compile_rules(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [r for _, r in rules]
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            coded = [np.concatenate([np.frombuffer(b"." + h.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64), [EDGE], np.frombuffer(p.encode("utf-8", "surrogatepass"), np.uint8)]) for h, p in parts]
            won = np.full(len(parts), -1)
            ranked = np.argsort([len(c) for c in coded], kind="stable")
            k = 0
            while k < len(ranked):  # blocks of like lengths, bounded in cells
                to = k + 1
                while to < len(ranked) and to - k < BLOCK_ROWS and (to - k + 1) * len(coded[ranked[to]]) <= BLOCK_CELLS:
                    to += 1
                take = ranked[k:to]
                fits = simulate(auto, [coded[i] for i in take])
                for r in reversed(order):
                    won[take[fits[:, r]]] = r
                k = to
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([names[w] if w >= 0 else None for w in won], pa.string()),
                    pa.array([rules[w][0] if w >= 0 else default for w in won], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col).cast("string")).mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
