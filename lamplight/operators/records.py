"""Numbered records out of whole documents.

Every extractor is one regular expression over a document, exploded to its matches, with groups taken from the short
match. Records carry ``doc_id`` and ``pos`` (their place), and share one nullable schema, so families are united by name.
The window functions partition by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions.text import WS, contains_any, elixir_category, liqueur_category, trim_all

FIELDS = {
    "doc_id": "bigint", "pos": "int", "emit_seq": "bigint", "id": "string", "number": "int", "name": "string", "content": "string", "full_text": "string", "source_pattern": "string", "category": "string",
    "source_book": "string", "original_number": "int", "original_paragraph": "int", "original_recipe_number": "int", "french_name": "string",
}

#: Names of headings, not of records (fixed values).
HEADINGS = [
    "ГЛАВА", "Водки тминные", "Водки анисовые", "Водки ировые", "Водки померанцевые", "Водки фенхельные", "Водки розмариновые",
    "Полынные водки", "Водки из кудрявой мяты", "Лимонные водки", "Водки коричные", "Водки можжевеловые", "Водки мелиссные",
    "Водки дягилевые", "Водки девясильные", "Водки гвоздичные", "Водки цитварные", "Водки карминативные", "Водки желудочные",
    "Грудные водки", "Персиковые водки", "Водки, называемые крамбамбули", "Мастичные водки", "Водки от колики",
    "Водки укрепительные", "Водки ореховые", "Водки Игуменские", "Розолии", "Воздушные водки", "Кардамонные водки",
    "Водки для здоровья", "Ратафии", "Христофлеты", "Водки хлебные", "Водки оранжевые", "Водки серебряные", "Водки золотые",
    "Водки горькия",
]

# patterns of record families (fixed values); \z is the end of a document
MAIN = rf"\*\*(\d+)\.{WS}*([^*]+?)\.\*\*([\s\S]*?)(?=\*\*\d+\.|\z)"
STARRED = rf"\*\*(\d+)\.{WS}*([^*\n]+?)\*\*{WS}*([\s\S]*?)(?=\*\*\d+\.|\z)"
STARRED_TIGHT = rf"\*\*(\d+)\.{WS}*([^*\n]+?)\*\*([\s\S]*?)(?=\*\*\d+\.|\z)"
LIQUEUR_BRACKET = rf"\*\*(\d+)\){WS}*([^*]+?)\.\*\*{WS}*([\s\S]*?)(?=\*\*\d+[.)]|§{WS}*\d+\.|\z)"
LIQUEUR_DOT = rf"\*\*(\d+)\.{WS}*([^*]+?)\.\*\*{WS}*([\s\S]*?)(?=\*\*\d+[.)]|§{WS}*\d+\.|\z)"
ELIXIR = rf"§{WS}*(\d+)\.{WS}*\n(\d+)\.{WS}*([^\n]+?)\.{WS}*\n{WS}*\n([\s\S]*?)(?=§{WS}*\d+\.|\z)"
PARAGRAPH = rf"§{WS}*(\d+)\.{WS}*\n([^\n]+?)\.{WS}*\n{WS}*\n([\s\S]*?)(?=§{WS}*\d+\.|\z)"
PERFUME = rf"§{WS}*(\d+)\.{WS}*\n(\d+)\.{WS}*([^\n]+?)\.{WS}*\n([^\n]+?)\.?{WS}*\n{WS}*\n([\s\S]*?)(?=§{WS}*\d+\.|\z)"
FRENCH = rf"(?m)^(\d+)\.{WS}*([^\n]+?)\.?{WS}*\n([\s\S]*?)(?=^\d+\.|$)"
TITLE = rf"\A(\d+)\.{WS}*(.+?)\.?{WS}*\z"

WITH_INGREDIENTS = r"(?iu)(?:Возьмите|Состав|Набор):"
FRENCH_INGREDIENTS = r"(?iu)(?:Возьми|французской водки|настаивать)"


def matches(docs: DataFrame, pattern: str, text_col: str = "text", at: str = "pos") -> DataFrame:
    """One row per match, with its place and whole text ``hit``."""
    return docs.select("*", F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias(at, "hit"))


def group(pattern: str, k: int, hit: Column | None = None) -> Column:
    return F.regexp_extract(F.col("hit") if hit is None else hit, pattern, k)


def shaped(df: DataFrame, **given: Column) -> DataFrame:
    """The common schema: given columns, null for the rest; full_text defaults to name, blank line, content."""
    given.setdefault("full_text", F.concat_ws("\n\n", given["name"], given["content"]))
    return df.select(*[(given[k] if k in given else F.col(k) if k in ("doc_id", "pos") else F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def bare_name(c: Column) -> Column:
    return F.regexp_replace(trim_all(c), r"\.\z", "")


def main_records(docs: DataFrame) -> DataFrame:
    """Starred headings with a dot, contents of at least 100 characters."""
    m = matches(docs.where(F.col("text").contains("**")), MAIN)
    m = m.select("doc_id", "pos", group(MAIN, 1).try_cast("int").alias("number"), trim_all(group(MAIN, 2)).alias("name"), trim_all(group(MAIN, 3)).alias("content"))
    return shaped(m.where(F.char_length("content") >= 100), number=F.col("number"), name=F.col("name"), content=F.col("content"))


def capped(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each document, by ``pos``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("rank") <= most).drop("rank")


def starred_records(docs: DataFrame, most: int = 300) -> DataFrame:
    """Starred headings that are no chapter headings, at most ``most`` accepted ones a document (a limit of the format)."""
    m = matches(docs.where(F.col("text").contains("**")), STARRED)
    m = m.select("doc_id", "pos", group(STARRED, 1).try_cast("int").alias("number"), bare_name(group(STARRED, 2)).alias("name"), trim_all(group(STARRED, 3)).alias("content"))
    m = m.where(~contains_any(F.col("name"), HEADINGS) & (F.char_length("content") >= 100) & (F.char_length("name") > 3))
    m = capped(m, most)
    return shaped(m, id=F.col("number").cast("string"), number=F.col("number"), name=F.col("name"), content=F.col("content"), source_pattern=F.lit("main_pattern"))


def vodka_records(docs: DataFrame) -> DataFrame:
    m = matches(docs.where(F.col("text").contains("**")), STARRED_TIGHT)
    m = m.select("doc_id", "pos", group(STARRED_TIGHT, 1).try_cast("int").alias("number"), bare_name(group(STARRED_TIGHT, 2)).alias("name"), trim_all(group(STARRED_TIGHT, 3)).alias("content"))
    m = m.where(~contains_any(F.col("name"), ["ГЛАВА", "§"]) & (F.char_length("content") >= 50) & (F.char_length("name") > 3))
    return shaped(m, id=F.concat(F.lit("recipe_"), "number"), number=F.col("number"), name=F.col("name"), content=F.col("content"), source_pattern=F.lit("starred_number_title"), category=F.lit("водка"), source_book=F.lit("original"))


def liqueur_records(docs: DataFrame) -> DataFrame:
    """Both liqueur passes, without numbers yet: the second leaves out original numbers that the first has, and of its own the later ones."""

    def rows(pattern: str, tag: str) -> DataFrame:
        m = matches(docs, pattern)
        m = m.select("doc_id", "pos", group(pattern, 1).try_cast("int").alias("original"), trim_all(group(pattern, 2)).alias("name"), trim_all(group(pattern, 3)).alias("content"))
        m = m.where(F.col("content").rlike(WITH_INGREDIENTS) & (F.char_length("content") > 50))
        if tag == "liqueur_dot_pattern":
            m = m.where(F.lower("name").contains("ликёр"))
        name = F.concat(F.lit("Ликёр "), F.regexp_replace("name", rf"(?iu)\AЛикёр{WS}*", ""))
        return shaped(m, original_number=F.col("original"), name=name, content=F.col("content"), source_pattern=F.lit(tag), category=F.lit("ликёр"))

    first = rows(LIQUEUR_BRACKET, "paragraph_liqueur")
    second = first_wins(rows(LIQUEUR_DOT, "liqueur_dot_pattern"), "original_number", taken=first)
    return first.unionByName(second)


def first_wins(df: DataFrame, key: str, taken: DataFrame | None = None) -> DataFrame:
    """The first row of each key in a document, and none whose key an earlier pass has taken."""
    w = Window.partitionBy("doc_id", key).orderBy("pos")
    out = df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return out.join(taken.select("doc_id", key).distinct(), ["doc_id", key], "left_anti").select(*df.columns) if taken is not None else out


def scanned_lines(docs: DataFrame, lowest: int = 1, highest: int = 350, text_col: str = "text", separator: str = "\n") -> DataFrame:
    """A line scanner as gaps and islands: a title opens a record, other lines that are not empty are its body.

    Rows: doc_id, number, name, content, pos, valid (a title out of range only closes the record before it).
    """
    lines = docs.select("doc_id", F.posexplode(F.split(text_col, separator, -1)).alias("pos", "raw")).select("doc_id", "pos", trim_all(F.col("raw")).alias("line"))
    lines = lines.withColumn("title", F.col("line").rlike(TITLE))
    island = F.sum(F.col("title").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("island", island).where((F.col("island") > 0) & (F.col("line") != ""))
    body = F.array_sort(F.collect_list(F.when(~F.col("title"), F.struct("pos", "line"))))
    out = lines.groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), F.max(F.when(F.col("title"), F.col("line"))).alias("head"), body.alias("body"))
    number, name = F.regexp_extract("head", TITLE, 1).try_cast("int"), trim_all(F.regexp_extract("head", TITLE, 2))
    return out.select(
        "doc_id", "pos", number.alias("number"), name.alias("name"), trim_all(F.array_join(F.transform("body", lambda x: x["line"]), "\n")).alias("content"),
        F.coalesce((number >= lowest) & (number <= highest) & (F.char_length(name) > 3), F.lit(False)).alias("valid"),
    )


def plain_records(docs: DataFrame, taken: DataFrame, highest: int = 350) -> DataFrame:
    """Records of the line scanner whose number is new, bodies over 50 characters, vodkas only."""
    m = scanned_lines(docs, highest=highest).where(F.col("valid") & (F.char_length("content") > 50))
    m = m.where(liqueur_category(F.col("content"), F.col("name")) == "водка")
    rows = shaped(m, id=F.concat(F.lit("recipe_"), "number"), number=F.col("number"), name=F.col("name"), content=F.col("content"), source_pattern=F.lit("plain_number_title"), category=F.lit("водка"))
    return first_wins(rows, "number", taken)


def numbered(df: DataFrame, start: DataFrame, order: list[str]) -> DataFrame:
    """Number rows of each document on from ``start`` (doc_id, next), in the given order."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    out = df.withColumn("__k", F.row_number().over(w)).join(start, "doc_id", "left")
    number = F.coalesce("next", F.lit(1)) + F.col("__k") - 1
    return out.withColumn("number", number.cast("int")).withColumn("id", F.concat(F.lit("recipe_"), F.col("number").cast("string"))).select(*df.columns)


def vodka_book(docs: DataFrame, first_liqueur: int = 210, enough: int = 200) -> DataFrame:
    """Vodkas, then liqueurs numbered on from the greater of the last vodka and 209, then vodkas by the line scanner where the
    starred pass found fewer than ``enough``; sorted by number, earlier finds first."""
    vodkas = vodka_records(docs)
    start = docs.select("doc_id").distinct().join(vodkas.groupBy("doc_id").agg(F.max("number").alias("top"), F.count("*").alias("found")), "doc_id", "left")
    start = start.select("doc_id", (F.greatest(F.coalesce("top", F.lit(0)), F.lit(first_liqueur - 1)) + 1).alias("next"), F.coalesce("found", F.lit(0)).alias("found"))
    liqueurs = numbered(liqueur_records(docs), start.select("doc_id", "next"), [F.col("source_pattern").desc(), "pos"])
    few = docs.join(start.where(F.col("found") < enough).select("doc_id"), "doc_id", "left_semi")
    plain = plain_records(few, vodkas.unionByName(liqueurs))
    family = F.when(F.col("source_pattern") == "starred_number_title", 0).when(F.col("source_pattern") == "paragraph_liqueur", 1).when(F.col("source_pattern") == "liqueur_dot_pattern", 2).otherwise(3)
    return united([vodkas, liqueurs, plain]).withColumn("emit_seq", family * F.lit(1 << 32) + F.col("pos")).orderBy("doc_id", "number", "emit_seq")


def elixir_records(docs: DataFrame) -> DataFrame:
    """Numbered elixirs, then simple ones whose paragraph is new."""
    verbs = ["Возьми", "настаивай", "перегони"]
    m = matches(docs, ELIXIR).select("doc_id", "pos", group(ELIXIR, 1).try_cast("int").alias("p"), group(ELIXIR, 2).try_cast("int").alias("r"), trim_all(group(ELIXIR, 3)).alias("name"), trim_all(group(ELIXIR, 4)).alias("content"))
    m = m.where(~contains_any(F.col("name"), ["ГЛАВА", "ОТДЕЛЕНИЕ"]) & ~F.col("content").contains("Стр.") & (F.char_length("content") > 60) & contains_any(F.col("content"), verbs))
    full = shaped(m, name=F.col("name"), content=F.col("content"), source_pattern=F.lit("elixir_numbered"), category=elixir_category(F.col("name")), source_book=F.lit("tinctures"), original_paragraph=F.col("p"), original_recipe_number=F.col("r"))
    m = matches(docs, PARAGRAPH).select("doc_id", "pos", group(PARAGRAPH, 1).try_cast("int").alias("p"), trim_all(group(PARAGRAPH, 2)).alias("name"), trim_all(group(PARAGRAPH, 3)).alias("content"))
    m = m.where(~contains_any(F.col("name"), ["ГЛАВА", "ОТДЕЛЕНИЕ"]) & (F.char_length("content") > 60) & contains_any(F.col("content"), verbs))
    simple = shaped(m, name=F.col("name"), content=F.col("content"), source_pattern=F.lit("elixir_simple"), category=elixir_category(F.col("name"), short=True), source_book=F.lit("tinctures"), original_paragraph=F.col("p"))
    return full.unionByName(first_wins(simple, "original_paragraph", full))


def perfume_records(docs: DataFrame) -> DataFrame:
    m = matches(docs, PERFUME).select(
        "doc_id", "pos", group(PERFUME, 1).try_cast("int").alias("p"), group(PERFUME, 2).try_cast("int").alias("r"), trim_all(group(PERFUME, 3)).alias("raw"),
        trim_all(group(PERFUME, 4)).alias("french"), trim_all(group(PERFUME, 5)).alias("content"),
    )
    m = m.where((F.char_length("content") > 100) & contains_any(F.col("content"), ["Возьми", "К приготовлению", "настаивать"]))
    m = m.withColumn("name", F.when(F.lower("raw").contains("вода"), F.col("raw")).otherwise(F.concat(F.lit("Вода "), "raw")))
    full = F.concat("name", F.lit("\n"), F.when(F.col("french") != "", F.concat("french", F.lit("\n"))).otherwise(""), F.lit("\n"), "content")
    return shaped(m, name=F.col("name"), content=F.col("content"), full_text=full, french_name=F.col("french"), source_pattern=F.lit("perfume_water"), category=F.lit("благовонная_вода"), source_book=F.lit("perfume"), original_paragraph=F.col("p"), original_recipe_number=F.col("r"))


def oil_records(docs: DataFrame) -> DataFrame:
    m = matches(docs, PARAGRAPH).select("doc_id", "pos", group(PARAGRAPH, 1).try_cast("int").alias("p"), trim_all(group(PARAGRAPH, 2)).alias("name"), trim_all(group(PARAGRAPH, 3)).alias("content"))
    m = m.where(~contains_any(F.col("name"), ["ГЛАВА", "О приготовлении"]) & (F.char_length("content") >= 100) & contains_any(F.lower("name"), ["масло", "oleum"]) & contains_any(F.col("content"), ["Возьми", "растолки", "перегони"]))
    return shaped(m, name=F.col("name"), content=F.col("content"), source_pattern=F.lit("aromatic_oil"), category=F.lit("ароматическое_масло"), source_book=F.lit("oils"), original_paragraph=F.col("p"))


def french_records(docs: DataFrame) -> DataFrame:
    """Liqueurs of sections of at least 200 characters; a record's content is the first line after its title that is not blank. ``pos`` counts the matches of a document."""
    sections = docs.select("doc_id", F.posexplode(F.split("text", rf"(?=§{WS}*\d+\.)", -1)).alias("section", "text")).where(F.char_length("text") >= 200)
    w = Window.partitionBy("doc_id").orderBy("section", "place")
    m = matches(sections, FRENCH, at="place").withColumn("pos", F.row_number().over(w) - 1)
    m = m.select("doc_id", "pos", group(FRENCH, 1).try_cast("int").alias("r"), trim_all(group(FRENCH, 2)).alias("raw"), trim_all(group(FRENCH, 3)).alias("content"))
    m = m.where(F.col("content").rlike(FRENCH_INGREDIENTS) & (F.char_length("content") >= 80))
    name = F.when(F.col("raw").startswith("Вода "), F.concat(F.lit("Ликёр "), F.substring("raw", 6, 1_000_000))).otherwise(F.concat(F.lit("Ликёр "), "raw"))
    return shaped(m, name=name, content=F.col("content"), source_pattern=F.lit("french_section"), category=F.lit("ликёр"), source_book=F.lit("french"), original_recipe_number=F.col("r"))


def gates(text: Column) -> dict[str, Column]:
    """Which families a document may hold: cheap tests before the patterns."""
    return {
        "starred": text.contains("**"),
        "french": text.contains("§") & ~text.contains("эссенция") & ~text.contains("тинктура"),
        "perfume": text.contains("О приготовлении душистых"),
        "oil": text.contains("О приготовлении разных масел"),
        "elixir": contains_any(text, ["эссенций, эликсиров и тинктур", "Эссенция", "Эликсир", "Тинктура"]),
    }


def running_start(totals: DataFrame, blocks: int = 1000) -> DataFrame:
    """(doc_id, next) where next = max(next before, top + 1) in the order of documents, and ``others`` numbers are used up by each.

    Totals are one row per document. They are ordered within blocks of documents; only sums and maxima of at most
    ``blocks`` blocks are ordered by one task.
    """
    cuts = F.array_distinct(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 10_000))
    edges = totals.agg(cuts.alias("cuts"))
    t = totals.join(F.broadcast(edges)).withColumn("block", F.size(F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c: c < F.col("doc_id")))).drop("cuts")
    inner = Window.partitionBy("block").orderBy("doc_id")
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("block").agg(F.sum("others").alias("s")).select("block", F.coalesce(F.sum("s").over(outer), F.lit(0)).alias("offset"))
    t = t.withColumn("sum", F.coalesce(F.sum("others").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(F.broadcast(sums), "block")
    t = t.withColumn("sum", F.col("sum") + F.col("offset")).withColumn("value", F.coalesce("top", F.lit(0)) + 1 - F.col("sum"))
    highs = t.groupBy("block").agg(F.max("value").alias("h")).select("block", F.coalesce(F.max("h").over(outer), F.lit(1)).alias("high"))
    t = t.withColumn("value", F.max("value").over(inner.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(highs), "block")
    return t.select("doc_id", (F.greatest("value", "high", F.lit(1)) + F.col("sum")).alias("next"))


def family_book(docs: DataFrame, shortest: int = 50_000) -> DataFrame:
    """All five families of long documents. Numbers run on over families and documents."""
    docs = docs.where(F.char_length("text") > shortest)
    g = gates(F.col("text"))
    parts = [vodka_records(docs.where(g["starred"])), french_records(docs.where(g["french"])), perfume_records(docs.where(g["perfume"])), oil_records(docs.where(g["oil"])), elixir_records(docs.where(g["elixir"]))]
    rows = united([p.withColumn("family", F.lit(k)) for k, p in enumerate(parts)])
    totals = rows.groupBy("doc_id").agg(F.max(F.when(F.col("family") == 0, F.col("number"))).alias("top"), F.sum((F.col("family") > 0).cast("int")).alias("others"))
    start = running_start(totals)
    simple = F.when(F.col("source_pattern") == "elixir_simple", 1).otherwise(0)
    later = numbered(rows.where("family > 0").withColumn("simple", simple), start, ["family", "simple", "pos"]).drop("simple")
    out = rows.where("family = 0").unionByName(later)
    return out.withColumn("emit_seq", F.col("family") * F.lit(1 << 32) + F.col("pos")).drop("family").orderBy("number", "doc_id", "emit_seq")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows that ``starts`` opens, in order within the keys; rows before the first are in run 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))
