"""Fuzzy matching of records to texts by their ids: candidates by shared grams and blocks, then an exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.text import first_nonempty, match_id, positional_similarity
from lamplight.sources.shared import stored

#: Bytes of a table of frequent keys that is broadcast at most; a larger one is joined.
BROADCAST_BYTES = 8 << 20
SIMILAR = 0.8
#: Rows of a key from which on they are dealt out by salt.
HOT = 1000
#: Lengths of grams: an id has a signature of the longest that fits into it.
GRAMS = (1, 2, 3, 5, 8)
#: Ids up to this length are compared by pairs of blocks, longer ones by single blocks.
PAIRED = 40


def dealt_join(few: DataFrame, many: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key``; rows of ``many`` with a key that more than HOT of them have are dealt out by salt, and meet copies of ``few``.

    ``counts`` (key, n) may give the rows of each key in ``many``; without it they are counted here.
    """
    counts = many.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.where(F.col("n") > HOT).select(key, F.ceil(F.col("n") / HOT).cast("int").alias("__salts"))
    # a row of the table is a short key and a number
    size = hot.agg(F.sum(F.octet_length(F.col(key).cast("string")) + 24)).first()[0] or 0
    if not size:
        return few.join(many, key)
    if size <= BROADCAST_BYTES:
        hot = F.broadcast(hot)
    salts = F.coalesce("__salts", F.lit(1))
    left = few.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    right = many.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), salts).cast("int")).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def grams(text: Column, width: int) -> Column:
    """The distinct substrings of a length; none where the text is shorter."""
    n = F.char_length(text)
    return F.when(n >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(width)) - width + 1), lambda i: F.substr(text, i, F.lit(width)))))


def contained_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): texts of two tables, none in both, of which one contains the other. The texts of a table are distinct and not empty.

    A text has one signature on the other side: of its grams of the longest length in GRAMS that fits, the one that the fewest texts there hold.
    If one of them is in no text there, nothing there contains it. Texts are looked up by all their grams, the candidates checked.
    """
    sides = left.select(F.col("l").alias("text"), F.lit("l").alias("side")).unionByName(right.select(F.col("r").alias("text"), F.lit("r").alias("side")))
    other = F.when(F.col("side") == "l", "r").otherwise("l")
    held = sides.select(F.col("text").alias("whole"), F.explode(F.flatten(F.filter(F.array(*[grams(F.col("text"), w) for w in GRAMS]), lambda g: g.isNotNull()))).alias("gram"), "side")
    # the side of the containing text is part of the key
    held = held.select("whole", F.concat("side", "gram").alias("gram"))
    counts = stored(held.groupBy("gram").agg(F.count("*").alias("n")))
    own = F.coalesce(*[grams(F.col("text"), w) for w in reversed(GRAMS)])
    asked = sides.select("text", "side", F.size(own).alias("k"), F.explode(own).alias("gram")).withColumn("gram", F.concat(other, "gram")).join(counts, "gram")
    signed = asked.groupBy("text", "side").agg(F.count("*").alias("found"), F.first("k").alias("k"), F.min(F.struct("n", "gram")).alias("g")).where("found = k").select("text", "side", F.col("g.gram").alias("gram"))
    pairs = dealt_join(signed, held, "gram", counts).where((F.char_length("whole") > F.char_length("text")) & F.contains("whole", "text"))
    return pairs.select(F.when(F.col("side") == "l", F.col("text")).otherwise(F.col("whole")).alias("l"), F.when(F.col("side") == "l", F.col("whole")).otherwise(F.col("text")).alias("r"))


def block_keys(text: Column, size: Column) -> Column:
    """Keys of a text within length class ``size``: texts whose longer one has that length and that differ in less than a fifth of its places share one.

    Place p belongs to block p modulo the number of blocks, so that a common beginning spreads over all of them. Of texts with d differing places at least
    blocks - d blocks agree: with d + 2 blocks a pair of them is a key, for long texts with d + 1 blocks a single one. Blocks that
    reach beyond the text differ anyway and give no key.
    """
    paired = size <= PAIRED
    blocks = F.floor((size - 1) / 5).cast("int") + F.when(paired, 2).otherwise(1)
    whole = F.filter(F.sequence(F.lit(0), blocks - 1), lambda b: b + blocks * F.floor((size - 1 - b) / blocks) < F.char_length(text))
    letters = F.split(text, "")
    places = F.sequence(F.lit(0), size - 1)

    def key(a: Column, b: Column) -> Column:
        held = F.filter(places, lambda p: F.pmod(p, blocks).isin(a, b))
        return F.concat_ws("/", size.cast("string"), a.cast("string"), b.cast("string"), F.array_join(F.transform(held, lambda p: F.get(letters, p)), ""))

    pairs = F.flatten(F.transform(whole, lambda a: F.transform(F.filter(whole, lambda b: b > a), lambda b: key(a, b))))
    return F.when(paired, pairs).otherwise(F.transform(whole, lambda a: key(a, a)))


def similar_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, similar): texts of two tables, none in both, with a positional similarity above 0.8.

    With M characters in the longer text, fewer than M / 5 places differ. Texts of M characters meet equally long and shorter ones
    in class M by a key of ``block_keys``; classes go up to a quarter above a text's own length.
    """

    def keyed(df: DataFrame, c: str, own: tuple[str, ...], longer: str) -> DataFrame:
        n = F.char_length(c)
        # the mark tells whose own length the class is: both texts', the left one's or the right one's
        classes = F.transform(F.sequence(n, F.floor((5 * n - 1) / 4).cast("int")), lambda m: F.struct(m.alias("size"), F.when(m == n, F.array(*map(F.lit, own))).otherwise(F.array(F.lit(longer))).alias("marks")))
        each = df.where(n > 4).select(c, F.explode(classes).alias("k")).select(c, "k.size", F.explode("k.marks").alias("mark"))
        return each.select(c, F.explode(block_keys(F.col(c), F.col("size"))).alias("key"), "mark").select(c, F.concat("mark", "key").alias("key"))

    met = dealt_join(keyed(left, "l", ("b", "l"), "r"), keyed(right, "r", ("b", "r"), "l"), "key")
    return met.withColumn("similar", positional_similarity(F.col("r"), F.col("l"))).where(F.col("similar") > SIMILAR).select("l", "r", "similar")


def match_texts(records: DataFrame, texts: DataFrame, id_col: str = "id") -> DataFrame:
    """Left join of records (id, name, category, ...) to the best of ``texts`` (id, full_text, pos).

    Equal ids are a hash join. What is left goes to the text whose id contains the record's or is contained in it, the
    longer containment first, else to the most similar above 0.8; ties go to the first text. Ids that are null or
    empty match nothing, and fall back to name and category. Adds full_text and text_found.
    No id is compared with all others: containment is looked for by the rarest gram, similarity, for what has none, by blocks of places of which
    some must agree; frequent grams and blocks are dealt out.
    """
    t = texts.where(first_nonempty(F.col(id_col)).isNotNull()).select(match_id(F.col(id_col)).alias("t_id"), F.col("full_text").alias("t_text"), F.col("pos").alias("t_pos"))
    r = records.drop("full_text").withColumn("__r", match_id(F.coalesce(F.col(id_col), F.lit(""))))
    first = t.groupBy("t_id").agg(F.min(F.struct("t_pos", "t_text")).alias("f")).select("t_id", F.col("f.t_text").alias("t_text"))
    equal = r.join(first, F.col("__r") == F.col("t_id"), "left")
    done = equal.where("t_id is not null").drop("t_id")
    rest = equal.where("t_id is null").drop("t_id", "t_text")
    # the answer depends on the compared form alone, so each form is looked up once
    probe = stored(rest.where("__r <> ''").select("__r").distinct())
    ids = stored(t.where("t_id <> ''").groupBy("t_id").agg(F.min("t_pos").alias("t_pos")))
    best = best_matches(probe, ids)
    found = best.join(first, "t_id").drop("t_id").withColumn("__hit", F.lit(True))
    fuzzy = rest.join(found, F.col("__r") == F.col("__q"), "left").drop("__q")
    both = done.withColumn("__hit", F.lit(True)).unionByName(fuzzy)
    fallback = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("category", F.lit("")))
    keep = [c for c in records.columns if c != "full_text"]
    return both.select(*keep, F.coalesce(first_nonempty(F.col("t_text")), fallback).alias("full_text"), F.coalesce("__hit", F.lit(False)).alias("text_found"))


def best_matches(probe: DataFrame, ids: DataFrame) -> DataFrame:
    """(__q, t_id): for each ``__r`` of ``probe`` the best of ``ids`` (t_id, t_pos), if there is one; texts are distinct, not empty, and none is in both."""
    records, names = probe.select(F.col("__r").alias("l")), ids.select(F.col("t_id").alias("r"))
    inside = contained_pairs(records, names).withColumn("a", -F.least(F.char_length("l"), F.char_length("r")))
    # of the containments of a record the longest counts
    inside = stored(best_of(inside, ids))
    left = records.join(inside.select(F.col("__q").alias("l")), "l", "left_anti")
    return inside.unionByName(best_of(similar_pairs(left, names).withColumn("a", -F.col("similar")), ids))


def best_of(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Of each ``l`` the ``r`` with the least ``a``, then the least position."""
    best = pairs.join(ids.withColumnRenamed("t_id", "r"), "r").groupBy("l").agg(F.min(F.struct("a", "t_pos", "r")).alias("best"))
    return best.select(F.col("l").alias("__q"), F.col("best.r").alias("t_id"))
