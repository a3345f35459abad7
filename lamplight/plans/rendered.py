"""Queries over documents rendered from the driver's tables in the forms that the extractors read, so that SQL can tell the rows from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import text as T
from lamplight.operators import ingredients, records, store
from lamplight.plans.registry import query
from lamplight.sources.readers import tables

BODY = "Истолочь и настаивать две недели, потом перегнать на тихом огне и слить. Хранить в тёмном месте, плотно закупорив; через месяц напиток готов к столу и не мутнеет."
SIZE = len(BODY)


def key_text() -> Column:
    return F.col("s_suppkey").cast("string")


def supplier_name() -> Column:
    return F.col("s_name")


def is_even() -> Column:
    return F.col("s_suppkey") % 2 == 0


def books(spark: SparkSession, d: str, piece: Column) -> DataFrame:
    """One document a nation, a piece of text for each of its suppliers in order."""
    rows = tables(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("doc_id"), F.struct("s_suppkey", piece.alias("t")).alias("p"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n").alias("text"))


def starred(closing: str) -> Column:
    return F.concat(F.lit("**"), key_text(), F.lit(". "), supplier_name(), F.lit(closing), F.lit(BODY))


@query(f"SELECT s_nationkey::BIGINT AS doc_id, s_suppkey::INT AS number, s_name AS name, {SIZE}::INT AS chars FROM supplier")
def main_family(spark: SparkSession, d: str) -> DataFrame:
    return records.main_records(books(spark, d, starred(".**\n"))).select("doc_id", "number", "name", F.char_length("content").alias("chars"))


@query(f"SELECT s_nationkey::BIGINT AS doc_id, s_suppkey::VARCHAR AS id, s_suppkey::INT AS number, s_name AS name, {SIZE}::INT AS chars, 'main_pattern' AS source_pattern FROM supplier")
def starred_family(spark: SparkSession, d: str) -> DataFrame:
    out = records.starred_records(books(spark, d, starred(".**\n\n")), most=1_000_000)
    return out.select("doc_id", "id", "number", "name", F.char_length("content").alias("chars"), "source_pattern")


@query(f"""SELECT s_nationkey::BIGINT AS doc_id, s_suppkey::INT AS original_number, 'Ликёр ' || s_name AS name, {SIZE + 8}::INT AS chars,
    CASE WHEN s_suppkey % 2 = 0 THEN 'paragraph_liqueur' ELSE 'liqueur_dot_pattern' END AS source_pattern FROM supplier""")
def liqueur_family(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in brackets, and numbers with a dot whose name tells a liqueur."""
    even = F.concat(F.lit("**"), key_text(), F.lit(") "), supplier_name(), F.lit(".** Состав: "), F.lit(BODY))
    odd = F.concat(F.lit("**"), key_text(), F.lit(". Ликёр "), supplier_name(), F.lit(".** Состав: "), F.lit(BODY))
    return records.liqueur_records(books(spark, d, F.when(is_even(), even).otherwise(odd))).select("doc_id", "original_number", "name", F.char_length("content").alias("chars"), "source_pattern")


@query("""WITH s AS (SELECT *, s_suppkey % 2 = 0 AS even FROM supplier), n AS (SELECT *, greatest(coalesce(max(s_suppkey) FILTER (even) OVER (PARTITION BY s_nationkey), 0), 209) + 1
        + sum((NOT even)::INT) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS later FROM s), k AS (SELECT *, CASE WHEN even THEN s_suppkey ELSE later END::INT AS number FROM n)
    SELECT s_nationkey::BIGINT AS doc_id, number, 'recipe_' || number AS id, CASE WHEN even THEN s_name ELSE 'Ликёр ' || s_name END AS name, CASE WHEN even THEN 'водка' ELSE 'ликёр' END AS category FROM k""")
def numbered_book(spark: SparkSession, d: str) -> DataFrame:
    """Vodkas under their numbers, liqueurs numbered on behind the last of them or behind 209."""
    odd = F.concat(F.lit("**"), key_text(), F.lit(") "), supplier_name(), F.lit(".** Состав: "), F.lit(BODY))
    return records.vodka_book(books(spark, d, F.when(is_even(), starred(".**\n")).otherwise(odd))).select("doc_id", "number", "id", "name", "category")


@query("SELECT s_nationkey::BIGINT AS doc_id, s_suppkey::INT AS number, s_name AS name, 'строка первая' || chr(10) || 'строка вторая' AS content, s_suppkey BETWEEN 1 AND 350 AS valid FROM supplier")
def scanned_books(spark: SparkSession, d: str) -> DataFrame:
    piece = F.concat(key_text(), F.lit(". "), supplier_name(), F.lit(".\n\n  строка первая \nстрока вторая"))
    return records.scanned_lines(books(spark, d, piece)).select("doc_id", "number", "name", "content", "valid")


@query(f"""SELECT s_nationkey::BIGINT AS doc_id, s_suppkey::INT AS original_paragraph, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1 END::INT AS original_recipe_number, s_name AS name, 'настойка' AS category,
    {SIZE + 7}::INT AS chars, CASE WHEN s_suppkey % 2 = 0 THEN 'elixir_numbered' ELSE 'elixir_simple' END AS source_pattern FROM supplier""")
def elixir_family(spark: SparkSession, d: str) -> DataFrame:
    """Numbered elixirs, and simple ones for paragraphs that hold no numbered one."""
    head = F.when(is_even(), F.concat((F.col("s_suppkey") + 1).cast("string"), F.lit(". "), supplier_name())).otherwise(supplier_name())
    piece = F.concat(F.lit("§ "), key_text(), F.lit(".\n"), head, F.lit(".\n\nВозьми "), F.lit(BODY))
    return records.elixir_records(books(spark, d, piece)).select("doc_id", "original_paragraph", "original_recipe_number", "name", "category", F.char_length("content").alias("chars"), "source_pattern")


@query(f"""SELECT s_nationkey::BIGINT AS doc_id, s_suppkey::INT AS original_paragraph, (s_suppkey + 1)::INT AS original_recipe_number, 'Вода ' || s_name AS name, 'Eau' AS french_name, {SIZE + 7}::INT AS chars,
    length('Вода ' || s_name) + {SIZE + 13}::INT AS full_chars FROM supplier""")
def perfume_family(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.when(is_even(), F.lit("Вода ")).otherwise(F.lit("")), supplier_name())
    piece = F.concat(F.lit("§ "), key_text(), F.lit(".\n"), (F.col("s_suppkey") + 1).cast("string"), F.lit(". "), raw, F.lit(".\nEau.\n\nВозьми "), F.lit(BODY))
    out = records.perfume_records(books(spark, d, piece))
    return out.select("doc_id", "original_paragraph", "original_recipe_number", "name", "french_name", F.char_length("content").alias("chars"), F.char_length("full_text").cast("long").alias("full_chars"))


@query(f"SELECT s_nationkey::BIGINT AS doc_id, s_suppkey::INT AS original_paragraph, 'Масло ' || s_name AS name, {SIZE + 7}::INT AS chars FROM supplier")
def oil_family(spark: SparkSession, d: str) -> DataFrame:
    piece = F.concat(F.lit("§ "), key_text(), F.lit(".\nМасло "), supplier_name(), F.lit(".\n\nВозьми "), F.lit(BODY))
    return records.oil_records(books(spark, d, piece)).select("doc_id", "original_paragraph", "name", F.char_length("content").alias("chars"))


@query(f"SELECT s_nationkey::BIGINT AS doc_id, s_suppkey::INT AS original_recipe_number, 'Ликёр ' || s_name AS name, {2 * SIZE + 8}::INT AS chars FROM supplier")
def french_family(spark: SparkSession, d: str) -> DataFrame:
    """A section for each record; of its body the first line counts."""
    name = F.concat(F.when(is_even(), F.lit("Вода ")).otherwise(F.lit("")), supplier_name())
    piece = F.concat(F.lit("§ "), key_text(), F.lit(".\n"), key_text(), F.lit(". "), name, F.lit(".\nВозьми "), F.lit(f"{BODY} {BODY}"), F.lit("\nвторая строка"))
    return records.french_records(books(spark, d, piece)).select("doc_id", "original_recipe_number", "name", F.char_length("content").alias("chars"))


def recipes(spark: SparkSession, d: str) -> DataFrame:
    """A recipe for each part, its size as the amount of one ingredient."""
    size = F.col("p_size").cast("string")
    content = F.concat(
        F.lit("Возьмите: анис — "), size, F.lit(" 1/2 золотников (около "), (F.col("p_size") * 4).cast("string"), F.lit(",5 г).\n3 штофа (около 3,69 л) водки.\n"), size, F.lit(" фунтов (около 819 г) изюму.\n"),
        F.lit("мята, шалфей — по 2 золотника (около 8,5 г).\nИстолочь и настаивать две недели."),
    )
    return ingredients.with_ingredients(tables(spark, d, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("name"), content.alias("content")))


ITEMS = """i(k, name, fixed, whole, unit, modern, modern_unit) AS (VALUES (0, 'анис', 0.5, 1, 'золотник', NULL, 'г'), (1, 'водки', 3, 0, 'штоф', 3.69, 'л'), (2, 'изюму', 0, 1, 'фунт', 819, 'г'), (3, 'мята', 2, 0, 'золотник', 8.5, 'г'),
        (4, 'шалфей', 2, 0, 'золотник', 8.5, 'г'), (5, 'водка', 3, 0, 'штоф', 3.69, 'л')),
    r AS (SELECT p_partkey AS number, i.name, (fixed + whole * p_size)::DOUBLE AS amount, unit, coalesce(modern::DOUBLE, p_size * 4 + 0.5)::DOUBLE AS modern_amount, modern_unit FROM part, i)"""


@query(f"WITH {ITEMS} SELECT number, name, amount, unit, modern_amount, modern_unit, round(modern_amount / 7.38, 6) AS per_litre, 7.38::DOUBLE AS base_volume FROM r")
def recipe_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """All four forms of measured ingredients, the keyword pass, volumes and amounts by the litre."""
    i = recipes(spark, d).select("number", F.explode("ingredients_per_liter").alias("i"))
    return i.select("number", "i.name", "i.amount", "i.unit", "i.modern_amount", "i.modern_unit", F.round("i.amount_per_liter", 6).alias("per_litre"), F.round("i.base_volume", 6).alias("base_volume"))


@query(f"WITH {ITEMS} SELECT number, name, amount AS historical_amount, unit AS historical_unit, CASE WHEN modern_amount = floor(modern_amount) THEN modern_amount::BIGINT::VARCHAR ELSE modern_amount::VARCHAR END || ' ' || modern_unit AS modern_equivalent FROM r")
def recipe_measures(spark: SparkSession, d: str) -> DataFrame:
    m = recipes(spark, d).select("number", F.explode("historical_measures").alias("m"))
    return m.select("number", "m.name", "m.historical_amount", "m.historical_unit", "m.modern_equivalent")


@query("SELECT p_partkey AS recipe_number, p_name AS name, 'historical' AS source_type, 6::INT AS n_items, 'и настаивать две недели.' AS description FROM part")
def recipe_rows(spark: SparkSession, d: str) -> DataFrame:
    return store.table_rows(recipes(spark, d)).select("recipe_number", "name", "source_type", F.size("ingredients").alias("n_items"), "description")


@query("SELECT p_partkey AS number, 'мяты' AS quality, 'анис' AS bracketed, lower(p_name) AS plain FROM part")
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return tables(spark, d, "part").select(F.col("p_partkey").alias("number"), T.clean_name(F.lit("- Свежей Мяты,")).alias("quality"), T.clean_name(F.concat(F.lit("анис ("), name, F.lit(") "))).alias("bracketed"), T.clean_name(F.concat(F.lit("- "), name, F.lit("!;"))).alias("plain"))


@query("""WITH t AS (SELECT doc_id, 'Рецепт: ' || coalesce(source, '') || chr(10) || chr(10) || 'Содержание: ' || coalesce(text, '') AS t FROM documents),
    s AS (SELECT *, substr(t, 1, 700) AS h FROM t), p AS (SELECT *, CASE WHEN strpos(h, ' ') > 0 THEN 700 - strpos(reverse(h), ' ') ELSE -1 END AS sp FROM s),
    c AS (SELECT doc_id, t, CASE WHEN length(t) <= 700 THEN t WHEN sp > 630 THEN substr(h, 1, sp) || '...' ELSE h || '...' END AS e FROM p)
    SELECT doc_id, md5(e) AS digest, length(t) > 700 AS was_truncated, length(t)::INT AS original_length, length(e)::INT AS embedding_length FROM c""")
def record_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    e = T.embedding_input(T.RECORD_TEMPLATE, [F.col("source"), F.col("text")], 700)
    return tables(spark, d, "documents").select("doc_id", F.md5(e["embedding_text"]).alias("digest"), *[e[c].alias(c) for c in ("was_truncated", "original_length", "embedding_length")])


@query("""SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN 'no vector' WHEN 1 THEN 'wrong length' WHEN 2 THEN 'not a number' WHEN 3 THEN 'zero vector' END AS error FROM embeddings""")
def vector_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Vectors unfit for the index beside the good ones; some are spoilt here."""
    v, k = F.col("embedding").cast("array<float>"), F.col("vec_id") % 7
    spoilt = F.when(k == 1, F.slice(v, 1, 10)).when(k == 2, F.transform(v, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x).cast("float"))).when(k == 3, F.transform(v, lambda x: F.lit(0).cast("float"))).when(k != 0, v)
    rows = tables(spark, d, "embeddings").select("vec_id", spoilt.alias("dense"))
    good, bad = store.quarantined(rows, store.vector_checks(64))
    return good.select("vec_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("vec_id", "error"))


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END::INT AS terms, len(embedding)::INT AS vector_dimension FROM embeddings""")
def upsert_points(spark: SparkSession, d: str) -> DataFrame:
    """Points with dense and sparse vectors: a third of them is written again, twice."""
    e = tables(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    sparse = lambda n: F.create_map(F.lit("ingredients"), F.create_map(*[x for k in range(n) for x in (F.lit(k), F.lit(2.0))]))
    old = e.withColumns({"sparse": sparse(1), "state": F.lit("old"), "version": F.lit(0)})
    third = e.where("id % 3 = 0")
    new = third.withColumns({"sparse": sparse(3), "state": F.lit("newer"), "version": F.lit(1)}).unionByName(third.withColumns({"sparse": sparse(2), "state": F.lit("new"), "version": F.lit(2)}))
    out = store.vector_sizes(store.upsert(old, new, ["id"], [F.col("version")]).withColumn("sparse_indices", F.map_keys(F.col("sparse")["ingredients"])))
    return out.select("id", "state", F.col("sparse_token_count").alias("terms"), "vector_dimension")


@query("""SELECT 'recipe_' || s_suppkey AS recipe_id, lower(s_name) AS name_lower, s_suppkey % 2 = 0 AS is_liqueur, s_suppkey % 3 = 0 AS is_vodka, CASE WHEN s_suppkey % 2 = 0 THEN length(s_name) ELSE 0 END::INT AS content_length, 'pattern' AS source_pattern, '' AS source_book FROM supplier""")
def payload_variants(spark: SparkSession, d: str) -> DataFrame:
    s = tables(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Водка "), supplier_name())).otherwise(supplier_name())
    rows = s.select(F.concat(F.lit("recipe_"), key_text()).alias("id"), F.col("s_suppkey").alias("number"), name.alias("name"), F.when(is_even(), supplier_name()).alias("content"), F.lit("").alias("full_text"), F.when(is_even(), "ликёр").alias("category"), F.lit("pattern").alias("source_pattern"))
    out = store.variant_payload(rows, "suppliers", "legacy")
    return out.select("recipe_id", F.regexp_replace("name_lower", "^водка ", "").alias("name_lower"), "is_liqueur", "is_vodka", "content_length", "source_pattern", "source_book")
