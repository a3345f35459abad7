"""SentencePiece encoding and decoding by a weighted finite-state transducer (operator 9).

Three transducers are compiled from a model file: the normaliser (a mark in front of the text and for each space), the
pieces, and byte fallback for characters without a piece. Their composition with an input is built lazily: a state is a
position and the last piece, an arc reads one more piece. In the tropical semiring a unigram model weighs an arc by the
piece's negated score; a merge model weighs it 0 where the two adjacent pieces are what merging their joint string
gives and infinity elsewhere, which leaves one finite path: the library's segmentation. The shortest path is the encoding.

Pieces hold the mark only at their beginning, so an input falls apart in front of each run of marks, and shortest paths
of these segments are kept in a bounded cache of the Python worker, which drops the transducer and its caches when it turns to another step.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import lean, slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Segments and pairs of pieces that a worker keeps, about, and the longest segment that advances with others.
KEPT_SEGMENTS = 300_000
KEPT_PAIRS = 300_000
LONGEST_KEPT = 64
#: Segments that advance together, and classes of characters in the transitions.
TOGETHER = 20_000
CLASSES = 128
NEVER = float("-inf")
ONE = (1,)
SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Kept:
    """Paths of segments, one after another in an array; the segments' places are a bounded dictionary."""

    def __init__(self, fst: PieceFst):
        self.fst = fst
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, segments: list[str]) -> np.ndarray:
        if len(self.place) > KEPT_SEGMENTS:
            self.clear()
        place = self.place
        known = len(place)
        out = np.fromiter([place.setdefault(s, len(place)) for s in segments], np.int64, len(segments))
        if len(place) > known:
            new = list(islice(place, known, None))
            ids, n = self.fst.paths(new)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.size = np.concatenate([self.size, n])
            self.ids = np.concatenate([self.ids, ids])
        return out

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[at]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


class Pairs(dict):
    """(left, right) to whether merging their joint string gives just the two: the finite arcs of a merge model.

    Merges inside the two are known in order, with what then stands at the seam; the best merge goes first, the leftmost
    of ties. The pair holds unless a merge across the seam gets its turn.
    """

    def __init__(self, fst: PieceFst):
        super().__init__()
        self.fst = fst

    def __missing__(self, key: tuple[str, str]) -> bool:
        if len(self) > KEPT_PAIRS:
            self.clear()
        (left, x), (right, y) = self.fst.history(key[0])[1], self.fst.history(key[1])[0]
        score, i, j = self.fst.score.get, 0, 0
        seam = score(x + y, NEVER)
        ok = True
        while True:
            a = left[i][0] if i < len(left) else NEVER
            b = right[j][0] if j < len(right) else NEVER
            if seam > a and seam >= b:
                ok = False
                break
            if a >= b:
                if a == NEVER:
                    break
                x = left[i][1]
                i += 1
            else:
                y = right[j][1]
                j += 1
            seam = score(x + y, NEVER)
        self[key] = ok
        return ok


class PieceFst:
    """The compiled model: segments to shortest paths, one at a time or many at once, and ids back to text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or not spec.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with an identity normaliser are compiled")
        self.front = MARK if spec.normalizer_spec.add_dummy_prefix else ""
        self.merging = spec.trainer_spec.model_type == pb.TrainerSpec.BPE
        kinds = pb.ModelProto.SentencePiece
        self.ids, self.score, self.byte, self.shown, self.unknown = {}, {}, [0] * 256, [], 0
        for i, p in enumerate(spec.pieces):
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.ids[p.piece] = i
                self.score[p.piece] = p.score
                if re.search(f"[^{MARK}]{MARK}", p.piece):
                    raise ValueError("a piece holds the mark after other characters")
            if p.type == kinds.BYTE:
                self.byte[b := int(p.piece[3:5], 16)] = i
                self.shown.append(chr(b) if b < 128 else chr(0xDC00 + b))
            else:
                self.unknown = i if p.type == kinds.UNKNOWN else self.unknown
                self.shown.append(p.piece if i in (self.ids.get(p.piece),) else "")
        self.longest = max(map(len, self.ids), default=1)
        self.pairs = Pairs(self)
        self.kept = Kept(self)
        self.arc_keys, self.arc_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.histories: dict[str, tuple] = {}
        starts: dict[str, set[int]] = {}  # what a state's next characters leave of the arcs: lengths of pieces by their first three
        for p in self.ids:
            if not self.merging or self.history(p)[2]:
                starts.setdefault(p[:3], set()).add(len(p))
        self.sizes = {k: tuple(sorted(v | (starts.get(k[:2], set()) if len(k) > 2 else set()) | {1}, reverse=True)) for k, v in starts.items()}

    def merged(self, s: str, steps: list | None = None) -> list[str]:
        """The segmentation by repeated merging of the adjacent pair with the best joint piece, the leftmost of ties.

        ``steps`` gets (score, first part, last part) after each merge.
        """
        parts = list(s)
        while True:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                v = self.score.get(parts[k] + parts[k + 1], NEVER)
                if v > best:
                    best, at = v, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))

    def history(self, piece: str) -> tuple:
        """((merges with the first part after each, first character), (the same at the end), whether it merges whole)."""
        if piece not in self.histories:
            steps: list = []
            whole = self.merged(piece, steps) == [piece]
            self.histories[piece] = (([(v, a) for v, a, _ in steps], piece[0]), ([(v, b) for v, _, b in steps], piece[-1]), whole)
        return self.histories[piece]

    def finite_path(self, s: str) -> list[str] | None:
        """The one path of finite weight through the composition of ``s`` with a merge model, longer pieces tried first.

        A state with no finite way on is left for good: ``dead`` holds it, so each is left once.
        """
        n, ids, pairs, sizes = len(s), self.ids, self.pairs, self.sizes
        path: list[str] = []
        trials: list = []
        dead: set[tuple[int, int]] = set()  # (position, length of the last piece)
        at, last = 0, ""
        around = iter(sizes.get(s[0:3]) or sizes.get(s[0:2]) or ONE)
        while at < n:
            for size in around:
                piece = s[at : at + size]
                if piece in ids and at + size <= n and (not last or pairs[last, piece]) and (not dead or (at + size, size) not in dead):
                    trials.append(around)
                    path.append(piece)
                    at += size
                    last = piece
                    around = iter(sizes.get(s[at : at + 3]) or sizes.get(s[at : at + 2]) or ONE)
                    break
            else:
                if not path:
                    return None
                dead.add((at, len(last)))
                at -= len(path.pop())
                around = trials.pop()
                last = path[-1] if path else ""
        return path

    def least_path(self, s: str) -> list[str]:
        """Shortest path through a unigram model's lattice over ``s``, whose characters all have pieces or fall back."""
        far = [0.0] + [float("inf")] * len(s)
        back = [0] * (len(s) + 1)
        for at in range(len(s)):
            for to in range(at + 1, min(len(s), at + self.longest) + 1):
                v = self.score.get(s[at:to])
                if v is None:
                    if to > at + 1:
                        continue
                    v = -1e6
                if far[at] - v < far[to]:
                    far[to], back[to] = far[at] - v, at
        out = []
        to = len(s)
        while to:
            out.append(s[back[to] : to])
            to = back[to]
        return out[::-1]

    def segment(self, s: str) -> list[str]:
        if not self.merging:
            return self.least_path(s)
        if s in self.ids and self.history(s)[2]:
            return [s]
        out: list[str] = []
        start = 0
        for k in range(len(s) + 1):
            if k == len(s) or s[k] not in self.ids:  # a character without a piece takes part in no merge
                if k > start:
                    part = s[start:k]
                    out += self.finite_path(part) or self.merged(part)
                if k < len(s):
                    out.append(s[k])
                start = k + 1
        return out

    def path_ids(self, s: str) -> list[int]:
        """Shortest path of one segment, as ids, with byte fallback."""
        ids = self.ids
        out: list[int] = []
        for p in self.segment(s):
            if p in ids:
                out.append(ids[p])
            else:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")] if self.byte[0] else [self.unknown]
        return out

    @cached_property
    def trie(self) -> tuple[np.ndarray, ...]:
        """(class of each character, 0 for rare ones; transitions, state 0 dead and 1 first; piece that ends in a state).

        Classes go to the characters that most pieces hold; a segment with another character is composed on its own.
        """
        often = Counter(c for p in self.ids for c in set(p))
        classes = np.zeros(0x110000, np.uint8)
        for k, (c, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))[: CLASSES - 1], 1):
            classes[ord(c)] = k
        moves: list[dict[int, int]] = [{}, {}]
        ends = [-1, -1]
        for p, i in self.ids.items():
            codes = [int(classes[ord(c)]) for c in p]
            if 0 in codes or not self.history(p)[2]:
                continue
            at = 1
            for c in codes:
                if c not in moves[at]:
                    moves[at][c] = len(moves)
                    moves.append({})
                    ends.append(-1)
                at = moves[at][c]
            ends[at] = i
        table = np.zeros((len(moves), CLASSES), np.int32)
        for k, m in enumerate(moves):
            table[k, list(m)] = list(m.values())
        return classes, table, np.array(ends, np.int32)

    @cached_property
    def names(self) -> dict[int, str]:
        return {i: p for p, i in self.ids.items()}

    def joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each arc (left, right) is finite, by a table of known arcs in front of ``pairs``."""
        key = left.astype(np.int64) << 32 | right
        at = ((key * 0x9E3779B1) >> 7) & (len(self.arc_keys) - 1)
        fresh = np.flatnonzero(self.arc_keys[at] != key)
        ok = self.arc_ok[at]
        if len(fresh):
            new, back = np.unique(key[fresh], return_inverse=True)
            names, pairs = self.names, self.pairs
            got = np.fromiter((pairs[names[k >> 32], names[k & 0xFFFFFFFF]] for k in new.tolist()), bool, len(new))
            ok[fresh] = got[back]
            to = at[fresh]
            self.arc_keys[to], self.arc_ok[to] = key[fresh], ok[fresh]
        return ok

    def paths(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all shortest paths, their lengths). Segments advance together, a character at a time: of a merge model each
        prefix has one finite path, so its last piece is found by trying those that end there against the last piece of
        the prefix before. Segments of rare characters, long ones and those of unigram models are composed on their own."""
        counts = np.zeros(len(segments), np.int64)
        alone: dict[int, list[int]] = {}
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(segments), TOGETHER):
            part = segments[start : start + TOGETHER]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            if self.merging:
                classes, table, ends = self.trie
                text = np.frombuffer("".join(w + "\x00" for w in part).encode("utf-32-le", "surrogatepass"), np.uint32)
                code = np.concatenate([classes[text], np.zeros(self.longest, np.uint8)])
                base = np.cumsum(sizes + 1) - (sizes + 1)
                code[base + sizes] = 0
                fit = (np.add.reduceat(code[: len(text)] == 0, base) == 1) & (sizes <= LONGEST_KEPT)
                # by end of a piece: the piece of each length, and the next length not above each that has one
                piece = np.full((self.longest + 1, len(code) + 1), -1, np.int32)
                best = np.zeros((self.longest + 1, len(code) + 1), np.int8)
                live, state = np.arange(len(text)), np.ones(len(text), np.int32)
                for d in range(1, self.longest + 1):
                    state = table[state, code[live + d - 1]]
                    live, state = live[state > 0], state[state > 0]
                    end = ends[state]
                    best[d] = best[d - 1]
                    piece[d, live + d] = end
                    best[d, live[end >= 0] + d] = d
                last, long = np.full(len(code) + 1, -1, np.int64), np.zeros(len(code) + 1, np.int64)
                by_size = np.flatnonzero(fit)
                by_size = by_size[np.argsort(sizes[by_size], kind="stable")]
                sorted_sizes = sizes[by_size]
                for i in range(1, int(sorted_sizes[-1] if len(by_size) else 0) + 1):
                    who = by_size[np.searchsorted(sorted_sizes, i) :]
                    first, at = base[who], base[who] + i
                    d = best[self.longest, at].astype(np.int64)
                    while len(at):
                        left = at - d
                        new, old = piece[d, at].astype(np.int64), last[left]
                        ok = d > 0
                        test = np.flatnonzero(ok & (left > first))
                        ok[test] = old[test] >= 0
                        test = test[old[test] >= 0]
                        ok[test] = self.joint(old[test], new[test])
                        last[at[ok]], long[at[ok]] = new[ok], d[ok]
                        go = ~ok & (d > 0)
                        first, at, d = first[go], at[go], best[d[go] - 1, at[go]].astype(np.int64)
                fit &= last[base + sizes] >= 0
                who = np.flatnonzero(fit)
                at = (base + sizes)[who]
                while len(who):
                    found.append((start + who << 32 | at, last[at]))
                    at = at - long[at]
                    who, at = who[at > base[who]], at[at > base[who]]
            else:
                fit = np.zeros(len(part), bool)
            for k in np.flatnonzero(~fit):
                alone[start + int(k)] = self.path_ids(part[k])
        where = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in found)])
        ids = np.concatenate([np.zeros(0, np.int64), *(v for _, v in found)])
        if alone:
            single = np.zeros(len(segments), bool)
            single[list(alone)] = True
            keep = ~single[where >> 32]
            where = np.concatenate([where[keep], *(np.int64(k << 32) + np.arange(len(v)) for k, v in alone.items())])
            ids = np.concatenate([ids[keep], *(np.array(v, np.int64) for v in alone.values())])
        order = np.argsort(where, kind="stable")
        counts += np.bincount(where >> 32, minlength=len(segments))
        return ids[order].astype(np.int32), counts

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their lengths)."""
        lists = [SEGMENT.findall(self.front + t.replace(" ", MARK)) if t else [] for t in texts]
        flat = list(chain.from_iterable(lists))
        at = self.kept.numbers(flat)
        ids, n = self.kept.gather(at)
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum([len(x) for x in lists])
        return ids, sums[ends] - sums[np.concatenate([[0], ends[:-1]])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """Pieces back to text: marks are spaces, the front mark goes, runs of bytes are read as UTF-8."""
        s = "".join(map(self.shown.__getitem__, ids)).replace(MARK, " ")
        if not s.isascii():
            s = s.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return s[1:] if self.front and s[:1] == " " else s


@lru_cache(maxsize=2)
def load(path: str) -> PieceFst:
    return PieceFst(path)


def encode_pieces(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids, round_trip.

    ids equal the library's; round_trip says that decoding them gives the text back (with the mark itself read as a
    space). Null and empty texts have no pieces and come back empty. Repeated rows get a row each, null ids stay null,
    texts of any length are encoded whole, an empty table gives no rows. Other columns are not read.
    """
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = load(path)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, n = fst.encode_all(texts)
                ends = np.concatenate([[0], np.cumsum(n)])
                back = ids.tolist()
                same = [fst.decode(back[ends[k] : ends[k + 1]]) == t.replace(MARK, " ") for k, t in enumerate(texts)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists, pa.array(same)], names=["doc_id", "n_pieces", "ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lean(run, load), f"doc_id {kind}, n_pieces long, ids array<int>, round_trip boolean")


def decode_pieces(rows: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text from rows of piece ids. Null or empty ids give an empty text; ids out of range fail."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fst.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col), F.col(ids_col)).mapInArrow(lean(run, load), f"doc_id {rows.schema[id_col].dataType.simpleString()}, text string")
