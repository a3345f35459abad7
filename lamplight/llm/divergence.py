"""Divergence of sources within a language by a systolic rotation of their term counts (operator 13).

Tasks count the terms of each language and source in bounded tables; one shuffle by term adds them up and tells which terms
are kept. Each group's counts become vectors of bounded stretches of the vocabulary. Groups form teams, and each team has a
seat for each stretch: there its vectors stay, while compressed copies of the other teams' come by in the rounds of a
tournament in which every two teams meet once. A meeting gives both directions. The rounds are a column of one shuffle, so
a seat reads its residents and then its visitors one after the other. Heaps at the seats rank terms.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.llm.common import dense_ids, groups_of, slices, written
from lamplight.llm.phrases import pack, unpack

LEAST, TOP = 10, 10
#: Terms of a stretch of a vocabulary, groups of a team: 8 x 65,536 counts of 8 bytes reside in a seat at most.
STRETCH, TEAM = 1 << 16, 8
#: Rows of counts that a task holds before it hands them on, and rows of a batch of them.
HELD, EMITTED = 1 << 19, 1 << 16
SCALE = 1_000_000_000
#: Below this sum of counts the parts of a share fit 64 bits; above it they are whole numbers of any size.
WIDE = 1 << 48

#: Letters and all that is not ASCII make terms, A-Z lower-cased; other bytes become spaces (fixed rule).
_TERM = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.encode().translate(_TERM).split()


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), exactly."""
    if total >= WIDE:
        return np.array([1 + SCALE * (int(c) + 2) // total for c in counts], np.int64)
    # in two divisions, so that no product passes 64 bits: 10^9 is 31250 x 32000
    first, rest = np.divmod((counts.astype(np.int64) + 2) * 31_250, total)
    return 1 + first * 32_000 + rest * 32_000 // total


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are below 2^31, so squares fit."""
    d = p - q
    return d * d // (p + q)


def visits(own: Column, teams: Column) -> Column:
    """Array of (seat, round): where a team's vectors go in a tournament of ``teams`` teams.

    By the circle method: in round r those two meet whose numbers add up to 2 r modulo an odd number, the one left over meets
    the last team. Each two meet once, no team has two meetings in a round, an odd number plays with an idle team. Of the two
    the lower one has the seat if their sum is odd, else the higher one, so that all seats get as many visitors.
    """
    odd = teams + F.pmod(teams, F.lit(2)) - 1

    def meeting(r: Column) -> Column:
        partner = F.pmod(2 * r - own, odd)
        return F.struct(F.when(own == odd, r).when(partner == own, odd).otherwise(partner).cast("int").alias("seat"), r.cast("int").alias("round"))

    goes = lambda m: (m["seat"] < teams) & F.when(F.pmod(own + m["seat"], F.lit(2)) == 1, own > m["seat"]).otherwise(own < m["seat"])
    return F.filter(F.transform(F.sequence(F.lit(0), odd - 1), meeting), goes)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs): sums over what a task held."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    rows = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), sums in held.items():
            for start in range(0, len(sums), EMITTED):
                some = list(islice(sums, start, start + EMITTED))
                both = np.fromiter((sums[t] for t in some), np.int64, len(some))
                same = pa.array(np.zeros(len(some), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]).take(same), pa.array([source]).take(same), pa.array(some, pa.binary()).cast(pa.string()), pa.array(both >> 32), pa.array(both & 0xFFFFFFFF)],
                    names=["lang", "source", "term", "n", "docs"],
                )

    for batch in batches:
        for some in slices(batch, 2):
            for lang, source, text in zip(*(some.column(k).to_pylist() for k in range(3))):
                sums = held.setdefault((lang, source), {})
                rows -= len(sums)
                for term, n in Counter(terms_of(text)).items():
                    # the count above, the number of documents in the lower 32 bits
                    sums[term] = sums.get(term, 0) + (n << 32 | 1)
                rows += len(sums)
            if rows >= HELD:
                yield from emit()
                held.clear()
                rows = 0
    yield from emit()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (gid, stretch, at, n, all) to one row of a group and stretch: its sum, and its places, counts and the language's counts."""
    for group in groups_of(batches, 2):
        columns = [group.column(k).to_numpy() for k in range(5)]
        data = pack(*(x.astype(np.uint64) for x in columns[2:]))
        yield pa.RecordBatch.from_arrays([pa.array([int(columns[0][0])]), pa.array([int(columns[1][0])]), pa.array([int(columns[3].sum())]), pa.array([data], pa.binary())], names=["gid", "stretch", "total", "vector"])


class Vector:
    """A group's counts in a stretch: places of its terms, their shares, and the share of a term that it does not hold."""

    def __init__(self, gid: int, at: np.ndarray, n: np.ndarray, total: int):
        self.gid, self.at, self.shares = gid, at, shares(n, total)
        self.none = int(shares(np.zeros(1, np.int64), total)[0])


def distance(a: Vector, b: Vector, width: int, scratch: np.ndarray) -> int:
    """Sum of gaps over the ``width`` terms of a stretch, those that neither holds included. ``scratch`` is zero before and after."""
    scratch[a.at] = a.shares
    mine = scratch[b.at]
    value = int(gaps(np.where(mine > 0, mine, a.none), b.shares).sum())
    scratch[b.at] = 0
    alone = scratch[a.at]
    alone = alone[alone > 0]
    scratch[a.at] = 0
    value += int(gaps(alone, np.full(len(alone), b.none)).sum())
    return value + (width - len(b.at) - len(alone)) * int(gaps(np.array([a.none]), np.array([b.none]))[0])


def _seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of seats in order, of each the residents first (round -1), then visitors by round, to (gid, part, item, value).

    Columns: home, stretch, seat, round, gid, width (terms of the stretch), base (id of its first term), total and every
    (denominators of the group's and the language's shares), vector.
    """
    seat, residents, scratch = None, [], np.zeros(STRETCH, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            home, stretch, place, round_, gid, width, base, total, every, data = (c[k].as_py() for c in batch.columns)
            if seat != (home, stretch, place):
                seat, residents = (home, stretch, place), []
            at, n, language = (np.zeros(0, np.int64),) * 3 if data is None else (x.astype(np.int64) for x in unpack(data))
            peer = Vector(gid, at, n, max(total, 1))
            out: list[tuple[int, str, int, int]] = []
            for other in residents:
                value = distance(other, peer, width, scratch)
                out += [(other.gid, "pair", gid, value), (gid, "pair", other.gid, value)]
            if round_ < 0:
                residents.append(peer)
                if len(at):
                    q = shares(language, every)
                    over = np.flatnonzero(peer.shares > q)
                    values = gaps(peer.shares[over], q[over])
                    out += [(gid, "term", base + place_, -v) for v, place_ in heapq.nsmallest(TOP, zip((-values).tolist(), at[over].tolist()))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["gid", "part", "item", "value"])


def source_divergence(docs: DataFrame, least: int = LEAST, team: int = TEAM, stretch: int = STRETCH, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """How far each (language, source) lies from the others of its language, and by which terms: (lang, source, part, item, value, rank).

    Terms are runs of ASCII letters, A-Z lower-cased, and of characters beyond ASCII; a language keeps those in at least ``least`` of its documents.
    With p = 1 + floor(10^9 (count + 2) / (N + 2 V)) of a group, a ``pair`` row sums floor((p - q)^2 / (p + q)) over all V kept terms, q being
    another source's; a ``term`` row has this figure of one term that the group holds with p above the language's q, its ten largest ones. Ranks
    go by value from the largest on, then by item. Null texts, languages and sources are empty strings. Each group that occurs has
    its pairs, with value 0 where its language keeps no term; a lone one has none. Repeated rows count each time, ids are not read; an empty table gives no rows.
    """
    stretch = min(stretch, STRETCH)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    groups = dense_ids(named.select("lang", "source").distinct(), [F.col("lang"), F.col("source")], "gid")
    # one shuffle, by term, serves the sums of groups and those of the language
    found = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    sums = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    sums = written(sums.withColumns({"docs": F.sum("docs").over(term), "all": F.sum("n").over(term)}).where(F.col("docs") >= least).drop("docs"))
    kept = dense_ids(sums.select("lang", "term", "all").distinct(), [F.col("lang"), F.col("term")], "id")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.min("id").alias("first"), F.sum("all").alias("every"))
    counts = sums.join(kept.drop("all"), ["lang", "term"]).join(groups, ["lang", "source"]).join(langs.select("lang", "first"), "lang")
    counts = counts.select("gid", (F.col("id") - F.col("first")).alias("place"), "n", "all")
    spread = counts.select("gid", F.floor(F.col("place") / stretch).cast("long").alias("stretch"), F.pmod(F.col("place"), F.lit(stretch)).alias("at"), "n", "all")
    vectors = written(spread.repartition("gid", "stretch").sortWithinPartitions("gid", "stretch", "at").mapInArrow(_vectors, "gid long, stretch long, total long, vector binary"))

    # every group has a row for every stretch of its language; ids of groups and terms are dense within a language
    totals = vectors.groupBy("gid").agg(F.sum("total").alias("total"))
    homes = groups.groupBy("lang").agg(F.min("gid").alias("home"), F.count("*").alias("members")).join(langs, "lang", "left")
    base = groups.join(homes, "lang").join(totals, "gid", "left").fillna(0, ["terms", "first", "every", "total"])
    base = base.withColumns({c: F.col(c) + 2 * F.col("terms") for c in ("total", "every")})
    base = base.withColumns({"team": F.floor((F.col("gid") - F.col("home")) / team), "teams": F.ceil(F.col("members") / team)})
    base = base.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("terms") - 1, F.lit(0)) / stretch).cast("long"))))
    width = F.least(F.lit(stretch), F.col("terms") - F.col("stretch") * stretch).cast("long")
    at_home = base.withColumns({"width": width, "base": F.col("first") + F.col("stretch") * stretch}).join(vectors.drop("total"), ["gid", "stretch"], "left")
    stays = F.concat(F.array(F.struct(F.col("team").cast("int").alias("seat"), F.lit(-1).alias("round"))), visits(F.col("team").cast("int"), F.col("teams").cast("int")))
    sent = at_home.withColumn("stay", F.explode(stays)).select("home", "stretch", "stay.seat", "stay.round", "gid", "width", "base", "total", "every", "vector")
    met = sent.repartition("home", "stretch", "seat").sortWithinPartitions("home", "stretch", "seat", "round", "gid").mapInArrow(_seats, "gid long, part string, item long, value long")
    values = met.groupBy("gid", "part", "item").agg(F.sum("value").alias("value"))
    values = written(values)

    pairs = values.where("part = 'pair'").join(groups.select(F.col("gid").alias("item"), F.col("source").alias("name")), "item")
    # the heaps of a group's stretches are joined before names are looked up; ids are in the order of the terms
    best = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    terms = values.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    terms = terms.join(kept.select(F.col("id").alias("item"), F.col("term").alias("name")), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "name"))).unionByName(terms)
    return ranked.join(groups, "gid").select("lang", "source", "part", F.col("name").alias("item"), "value", "rank")
