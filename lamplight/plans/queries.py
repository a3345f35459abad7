"""Queries over the driver's tables, each an application of library operators to whole tables, beside the SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import text as T
from lamplight.operators import chunks, ingredients, matching, records, statistics, store, vectors
from lamplight.plans.registry import query
from lamplight.sources.readers import tables
from lamplight.sources.shared import shared_folder, stored
from lamplight.streaming import grams, ingest, memory, parts


@query("SELECT doc_id, length(text)::INT AS chars FROM documents WHERE length(text) >= 100")
def scan_min_length(spark: SparkSession, d: str) -> DataFrame:
    good, _ = store.quarantined(tables(spark, d, "documents").select("doc_id", "text"), store.document_checks())
    return good.select("doc_id", F.char_length("text").alias("chars"))


@query("""SELECT doc_id, contains(text, '**') AS starred, contains(text, '§') AND NOT contains(text, 'эссенция') AND NOT contains(text, 'тинктура') AS french,
    contains(text, 'stupid') OR contains(text, 'idiot') OR contains(text, 'The ') AS worded, contains(text, chr(10)) AS lined, length(text) > 5000 AS long FROM documents""")
def doc_gate_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    g = records.gates(t)
    return tables(spark, d, "documents").select("doc_id", g["starred"].alias("starred"), g["french"].alias("french"), T.contains_any(t, ["stupid", "idiot", "The "]).alias("worded"), t.contains("\n").alias("lined"), (F.char_length(t) > 5000).alias("long"))


@query("""WITH e AS (SELECT doc_id, 'Source: ' || source || chr(10) || chr(10) || 'Content: ' || text AS t FROM documents),
    s AS (SELECT doc_id, t, substr(t, 1, 500) AS h, CASE WHEN strpos(substr(t, 1, 500), ' ') > 0 THEN 500 - strpos(reverse(substr(t, 1, 500)), ' ') ELSE -1 END AS sp FROM e),
    c AS (SELECT doc_id, t, CASE WHEN length(t) <= 500 THEN t WHEN sp > 450 THEN substr(h, 1, sp) || '...' ELSE h || '...' END AS cut FROM s)
    SELECT doc_id, cut AS embedding_text, length(t) > 500 AS was_truncated, length(t)::INT AS original_length, length(cut)::INT AS embedding_length FROM c""")
def truncate_at_word(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Source: "), "source", F.lit("\n\nContent: "), "text")
    df = tables(spark, d, "documents").select("doc_id", t.alias("t")).withColumn("cut", T.truncate_at_word(F.col("t"), 500))
    return df.select("doc_id", F.col("cut").alias("embedding_text"), (F.char_length("t") > 500).alias("was_truncated"), F.char_length("t").alias("original_length"), F.char_length("cut").alias("embedding_length"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '  +', ' ', 'g'), '(?m)^\s+|\s+$', '', 'g'), '([а-яё])\n([а-яё])', '\1 \2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "documents").select("doc_id", chunks.clean_scan(F.col("text")).alias("cleaned"))


CHUNKS = r"""w AS (SELECT doc_id, length(text) AS n_text, string_split_regex(text, '\s+') AS w FROM documents),
    k AS (SELECT doc_id, n_text, w, ceil(len(w) / 200.0)::INT AS total_chunks, unnest(range(ceil(len(w) / 200.0)::INT))::INT AS k FROM w),
    c AS (SELECT doc_id, (k + 1)::INT AS chunk_index, total_chunks, array_to_string(w[k * 200 + 1 : k * 200 + 200], ' ') AS text, n_text FROM k)"""


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, total_chunks, text FROM c")
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunked(tables(spark, d, "documents").select("doc_id", "text"), 200).drop("original_length")


@query(rf"""WITH {CHUNKS}, n AS (SELECT *, len([x FOR x IN string_split_regex(text, '\s+') IF x <> '']) AS wc FROM c)
    SELECT doc_id, chunk_index, wc::INT AS word_count, ceil(wc / 0.75)::BIGINT AS estimated_tokens, length(text)::INT AS character_count, floor(100.0 * length(text) / n_text + 0.5)::INT AS compression_ratio FROM n""")
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    c = chunks.described(chunks.chunked(tables(spark, d, "documents").select("doc_id", "text"), 200))
    return c.select("doc_id", "chunk_index", "word_count", "estimated_tokens", "character_count", "compression_ratio")


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][^.]*\.')) AS hit, generate_subscripts(regexp_extract_all(text, '[A-Z][^.]*\.'), 1) - 1 AS pos FROM documents)
    SELECT doc_id, pos::INT AS pos, regexp_extract(hit, '^([A-Z][^\s.]*)', 1) AS head, length(hit)::INT AS chars FROM m""")
def split_records(spark: SparkSession, d: str) -> DataFrame:
    m = records.matches(tables(spark, d, "documents").select("doc_id", "text"), r"[A-Z][^.]*\.")
    return m.select("doc_id", "pos", records.group(r"\A([A-Z][^\s.]*)", 1).alias("head"), F.char_length("hit").alias("chars"))


@query("""WITH i AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM conversations)
    SELECT conv_id, island::BIGINT AS island, min(turn) AS first_turn, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM i GROUP BY conv_id, island""")
def line_scanner(spark: SparkSession, d: str) -> DataFrame:
    i = records.islands(tables(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    return i.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    s AS (SELECT doc_id, greatest(max(pos), 209) + 1 AS next FROM l GROUP BY doc_id)
    SELECT doc_id, pos::INT AS pos, (next + pos)::INT AS number, 'recipe_' || (next + pos)::INT AS id FROM l JOIN s USING (doc_id)""")
def renumber_records(spark: SparkSession, d: str) -> DataFrame:
    lines = tables(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).drop("line").withColumn("number", F.lit(0)).withColumn("id", F.lit(""))
    start = lines.groupBy("doc_id").agg((F.greatest(F.max("pos"), F.lit(209)) + 1).alias("next"))
    return records.numbered(lines, start, ["pos"])


@query("""SELECT source, key, min(doc_id) AS pos FROM (SELECT source, lower(substr(text, 1, 40)) AS key, doc_id FROM documents)
    WHERE (source, key) NOT IN (SELECT source, lower(substr(text, 1, 40)) FROM documents WHERE doc_id % 10 = 3) GROUP BY source, key""")
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "documents").select(F.col("source").alias("doc_id"), F.lower(F.substring("text", 1, 40)).alias("key"), F.col("doc_id").alias("pos"))
    return records.first_wins(rows, "key", rows.where("pos % 10 = 3")).withColumnRenamed("doc_id", "source")


@query("""WITH f AS (SELECT min(source) AS first FROM documents), r AS (SELECT source, text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents, f WHERE source <> f.first)
    SELECT source, md5(text) AS digest, doc_id AS pos FROM r WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM documents e, f WHERE e.source = f.first AND e.text = r.text)""")
def first_wins_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as keys, over all sources at once; the first source is the earlier pass."""
    docs = tables(spark, d, "documents")
    rows = docs.crossJoin(F.broadcast(docs.agg(F.min("source").alias("first")))).select(F.lit("documents").alias("doc_id"), F.col("text").alias("key"), F.col("doc_id").alias("pos"), "source", "first")
    out = records.first_wins(rows.where("source <> first"), "key", rows.where("source = first"))
    return out.select("source", F.md5("key").alias("digest"), "pos")


@query("""SELECT doc_id, CASE WHEN contains(n, 'эссенция') OR contains(n, 'квинтэссенция') THEN 'эссенция' WHEN contains(n, 'эликсир') THEN 'эликсир' WHEN contains(n, 'тинктура') THEN 'тинктура'
    WHEN contains(n, 'капли') OR contains(n, 'жизненные') THEN 'жизненные_капли' WHEN contains(n, 'вода') AND NOT contains(n, 'раневая') THEN 'лечебная_вода' ELSE 'настойка' END AS category
    FROM (SELECT doc_id, lower(CASE doc_id % 7 WHEN 0 THEN 'Эссенция ' WHEN 1 THEN 'Эликсир ' WHEN 2 THEN 'Тинктура ' WHEN 3 THEN 'Капли ' WHEN 4 THEN 'Вода раневая ' WHEN 5 THEN 'Вода ' ELSE '' END || text) AS n FROM documents)""")
def category_cascade(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "documents").select("doc_id", T.elixir_category(F.concat(named(F.col("doc_id")), "text")).alias("category"))


def named(i):
    """A heading by number, as the tables have no Cyrillic ones."""
    out = F.lit("")
    for k, v in reversed(list(enumerate(("Эссенция ", "Эликсир ", "Тинктура ", "Капли ", "Вода раневая ", "Вода ")))):
        out = F.when(i % 7 == k, v).otherwise(out)
    return out


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def category_histogram(spark: SparkSession, d: str) -> DataFrame:
    return statistics.category_histogram(tables(spark, d, "documents").select(F.col("lang").alias("category")))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM l WHERE length(line) > 20)
    SELECT doc_id, pos::INT AS pos, length(line)::INT AS chars FROM a WHERE rank <= 5""")
def cap_per_document(spark: SparkSession, d: str) -> DataFrame:
    lines = tables(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.char_length("line") > 20)
    return records.capped(lines, 5).select("doc_id", "pos", F.char_length("line").alias("chars"))


@query("""SELECT p_partkey, p_size + (p_partkey % 7)::DOUBLE / (p_partkey % 5 + 1) AS mixed, (p_partkey % 7)::DOUBLE / (p_partkey % 5 + 1) AS fraction,
    p_size::DOUBLE AS prefix, 0.0::DOUBLE AS none, p_size + (p_partkey % 10) / 10.0::DOUBLE AS comma FROM part""")
def parse_number(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size").cast("string")
    fraction = F.concat((p % 7).cast("string"), F.lit("/"), (p % 5 + 1).cast("string"))
    return tables(spark, d, "part").select(
        "p_partkey", T.historical_number(F.concat_ws(" ", s, fraction)).alias("mixed"), T.historical_number(fraction).alias("fraction"), T.historical_number(F.concat(s, F.lit(",5 г"))).alias("prefix"),
        T.historical_number(F.col("p_brand")).alias("none"), T.decimal_comma(F.concat(s, F.lit(","), (p % 10).cast("string"))).alias("comma"),
    )


@query(r"""SELECT page_id, (regexp_extract(url, '/(\d+)', 1) || '.5')::DOUBLE AS volume, (page_id % 60)::DOUBLE AS strength FROM pages WHERE regexp_extract(url, '/(\d+)', 1) <> ''""")
def extract_measures(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("url", r"/(\d+)", 1)
    told = F.concat(n, F.lit(".5 ДКЛ, крепость "), (F.col("page_id") % 60).cast("string"), F.lit("° по траллесу"))
    volume, strength = T.volume_and_strength(told)
    return tables(spark, d, "pages").where(n != "").select("page_id", volume.alias("volume"), strength.alias("strength"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * CASE l_linenumber % 4 WHEN 0 THEN 1.23 WHEN 1 THEN 4.266 WHEN 2 THEN 409.5 ELSE 12.8 END, 6)::DOUBLE AS modern_amount FROM lineitem""")
def unit_convert(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    unit = F.when(n == 0, "штоф").when(n == 1, "золотник").when(n == 2, "фунт").otherwise("лот")
    return tables(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.convert_unit(F.col("l_quantity"), unit), 6).alias("modern_amount"))


@query("""WITH b AS (SELECT l_orderkey, coalesce(nullif(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), nullif(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), 1.0) AS base FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, l_linenumber, round(l_quantity / base, 6) AS amount_per_base, base::DOUBLE AS base_volume FROM lineitem JOIN b USING (l_orderkey)""")
def per_base_normalise(spark: SparkSession, d: str) -> DataFrame:
    items = order_items(spark, d, F.when(F.col("l_returnflag") == "R", "водка").otherwise("мята"), F.lit("л"))
    jugs = F.concat_ws("\n", F.transform(F.filter("rows", lambda r: r["l_linestatus"] == "F"), lambda r: F.concat(r["l_quantity"].cast("int").cast("string"), F.lit(" фунтов"))))
    spirit = F.aggregate(F.filter("rows", lambda r: r["l_linestatus"] == "F"), F.lit(0.0), lambda a, r: a + r["l_quantity"])
    told = ingredients.spirit_volume(F.col("items"), jugs)
    has = F.exists("items", lambda i: (i["name"] == "водка") & (i["modern_amount"] > 0))
    base = F.when(has, told).otherwise(F.coalesce(F.nullif(spirit, F.lit(0.0)), F.lit(1.0)))
    out = items.withColumn("base", base).select("l_orderkey", "rows", F.explode(F.arrays_zip(ingredients.per_litre(F.col("items"), F.col("base")).alias("p"), F.col("rows").alias("r"))).alias("x"))
    return out.select("l_orderkey", F.col("x.r.l_linenumber").alias("l_linenumber"), F.round("x.p.amount_per_liter", 6).alias("amount_per_base"), F.col("x.p.base_volume").alias("base_volume"))


def order_items(spark: SparkSession, d: str, name, modern_unit) -> DataFrame:
    """An order's lines as an array of ingredients, in their order."""
    row = F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", name.alias("name"), modern_unit.alias("unit"))
    orders = tables(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    item = lambda r: F.struct(r["name"].alias("name"), r["l_quantity"].alias("amount"), F.lit("штоф").alias("unit"), r["l_quantity"].alias("modern_amount"), r["unit"].alias("modern_unit"))
    return orders.withColumn("items", F.transform("rows", item).cast(ingredients.SCHEMA))


@query("""WITH f AS (SELECT l_orderkey, 'item ' || lower(l_returnflag) AS name, l_quantity, l_linestatus, l_linenumber,
        first_value(l_linestatus) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_quantity, l_linestatus) AS unit FROM lineitem)
    SELECT l_orderkey, name, unit AS modern_unit, sum(l_quantity) FILTER (l_linestatus = unit) AS modern_amount FROM f GROUP BY l_orderkey, name, unit""")
def dedup_sum_first_unit(spark: SparkSession, d: str) -> DataFrame:
    items = order_items(spark, d, F.concat(F.lit("- Item  "), "l_returnflag", F.lit(",")), F.col("l_linestatus"))
    return items.select("l_orderkey", F.explode(ingredients.merged(F.col("items"))).alias("i")).select("l_orderkey", "i.name", "i.modern_unit", "i.modern_amount")


ORDER_PARTS = "o AS (SELECT l_orderkey AS id, l_linenumber AS n, p_name AS name, p_brand AS brand, l_quantity AS q, l_returnflag AS u FROM lineitem JOIN part ON l_partkey = p_partkey)"


def order_parts(spark: SparkSession, d: str) -> DataFrame:
    lines = tables(spark, d, "lineitem").join(tables(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    row = F.struct(F.col("l_linenumber").alias("n"), F.col("p_brand").alias("name"), F.col("l_quantity").alias("modern_amount"), F.col("l_returnflag").alias("modern_unit"))
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("ingredients")).withColumn("name", F.concat(F.lit("order "), F.col("id").cast("string"))).withColumn("recipe_number", F.col("id").cast("int"))


@query(f"WITH {ORDER_PARTS} SELECT brand AS ingredient_name, u AS unit, count(*) AS usage_count, round(avg(q), 6) AS avg_amount FROM o GROUP BY brand, u HAVING count(*) > 1")
def ingredient_stats(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.ingredient_stats(order_parts(spark, d))
    return out.select("ingredient_name", "unit", "usage_count", F.round(F.col("avg_amount").cast("double"), 6).alias("avg_amount"))


@query(f"""WITH {ORDER_PARTS} SELECT id, 'order ' || id AS name, id::INT AS recipe_number, coalesce(string_agg(brand, '|' ORDER BY n, brand, q, u) FILTER (brand ILIKE '%brand#1%'), '') AS matching
    FROM o GROUP BY id HAVING bool_or(brand ILIKE '%brand#1%')""")
def search_by_element(spark: SparkSession, d: str) -> DataFrame:
    return statistics.search_by_element(order_parts(spark, d), "brand#1").select("id", "name", "recipe_number", F.array_join("matching_ingredients", "|").alias("matching"))


@query(f"""WITH {ORDER_PARTS} SELECT id, 'order ' || id AS name, id::INT AS recipe_number, coalesce(string_agg(brand, '|' ORDER BY n, brand, q, u) FILTER (brand ILIKE '%brand#13%'), '') AS matching
    FROM o GROUP BY id HAVING bool_or(brand ILIKE '%brand#13%')""")
def search_stored_element(spark: SparkSession, d: str) -> DataFrame:
    """The search over a stored table, by its postings."""
    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    parts.upsert_parts(spark, path, order_parts(spark, d), ["id"], [F.col("recipe_number")], "orders", 16, indexed="ingredients")
    out = statistics.search_by_element(grams.rows_with(spark, path, "brand#13"), "brand#13")
    return out.select("id", "name", "recipe_number", F.array_join("matching_ingredients", "|").alias("matching"))


@query("SELECT l_orderkey AS id, count(*)::INT AS n_items FROM lineitem GROUP BY l_orderkey ORDER BY n_items DESC, id LIMIT 5")
def top_by_array_length(spark: SparkSession, d: str) -> DataFrame:
    return statistics.top_by_items(order_parts(spark, d), 5).select("id", "n_items")


@query("""SELECT event_type, count(*) AS n, round(avg(json_extract_string(props, '$.k')::DOUBLE), 6) AS mean_k FROM events
    WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY event_type HAVING count(*) > 1""")
def json_extract_stats(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    return tables(spark, d, "events").withColumn("k", k).where("k is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("mean_k")).where("n > 1")


@query(f"WITH {ORDER_PARTS} SELECT id, brand AS name, count(*) AS n, sum(q) AS quantity FROM o GROUP BY id, brand")
def array_unnest_lateral(spark: SparkSession, d: str) -> DataFrame:
    one = order_parts(spark, d).select("id", F.explode("ingredients").alias("i"))
    return one.groupBy("id", F.col("i.name").alias("name")).agg(F.count("*").alias("n"), F.sum("i.modern_amount").alias("quantity"))


TERMS = {"ingredients": ["the", "und", "que"], "techniques": ["tion", "ung", "ment"], "measurements": ["555", "."]}


@query("""WITH v(space, idx, term, weight) AS (VALUES ('ingredients', 0, 'the', 2.0), ('ingredients', 1, 'und', 2.0), ('ingredients', 2, 'que', 2.0), ('techniques', 0, 'tion', 1.3), ('techniques', 1, 'ung', 1.3), ('techniques', 2, 'ment', 1.3),
        ('measurements', 0, '555', 1.0), ('measurements', 1, '.', 1.0)),
    c AS (SELECT doc_id, space, idx::INT AS idx, weight, ((length(t) - length(replace(t, term, ''))) / length(term))::INT AS n FROM (SELECT doc_id, lower(text || ' ' || source) AS t FROM documents), v)
    SELECT doc_id, space, idx, round(n * weight::DOUBLE, 6) AS weight FROM c WHERE n > 0""")
def sparse_tf_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.vocabulary_vectors(tables(spark, d, "documents"), TERMS, F.col("text"), F.col("source"))
    long = v.select("doc_id", F.explode("sparse").alias("space", "m")).select("doc_id", "space", F.explode("m").alias("idx", "weight"))
    return long.select("doc_id", "space", "idx", F.round("weight", 6).alias("weight"))


#: A vocabulary of five spaces and 300 terms by a rule: two letters after another, and each of them with a third.
WIDE_TERMS = {space: [a + b + c for a in first for b in "aeinorst" for c in ("", "e", "n")][:60] for space, first in zip(("ingredients", "spices_herbs", "techniques", "categories", "measurements"), ("det", "sal", "mir", "non", "unc"))}
WIDE_VALUES = ", ".join(f"('{space}', {k}, '{t}', {vectors.SPACE_WEIGHTS[space]})" for space, terms in WIDE_TERMS.items() for k, t in enumerate(terms))


@query(f"""WITH v(space, idx, term, weight) AS (VALUES {WIDE_VALUES}),
    c AS (SELECT doc_id, space, idx::INT AS idx, weight, ((length(t) - length(replace(t, term, ''))) / length(term))::INT AS n FROM (SELECT doc_id, lower(text || ' ' || source) AS t FROM documents), v)
    SELECT doc_id, space, idx, round(n * weight::DOUBLE, 6) AS weight FROM c WHERE n > 0""")
def sparse_tf_wide(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.vocabulary_vectors(tables(spark, d, "documents"), WIDE_TERMS, F.col("text"), F.col("source"))
    long = v.select("doc_id", F.explode("sparse").alias("space", "m")).select("doc_id", "space", F.explode("m").alias("idx", "weight"))
    return long.select("doc_id", "space", "idx", F.round("weight", 6).alias("weight"))


def dense_points(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, d: str, n: int) -> DataFrame:
    return tables(spark, d, "embeddings").where(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


DENSE = """dense AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id < {n})) WHERE rank <= 20)"""
SPARSE = """tok AS (SELECT doc_id AS id, unnest(list_distinct([x FOR x IN string_split_regex(lower(text), '[^a-z]+') IF x <> ''])) AS token FROM documents),
    sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.id AS query_id, t.id, count(*)::DOUBLE AS score FROM tok q JOIN tok t USING (token) WHERE q.id < {n} GROUP BY q.id, t.id)) WHERE rank <= 20)"""
FUSED = """f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM sparse) GROUP BY query_id, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM f)"""


@query(f"WITH {DENSE.format(n=1)} SELECT id, round(score, 6) AS score, rank::INT AS rank FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.dense_scores(dense_points(spark, d), query_vectors(spark, d, 1))
    return out.select("id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {DENSE.format(n=25)} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM dense")
def dense_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return vectors.dense_scores(dense_points(spark, d), query_vectors(spark, d, 25)).withColumn("score", F.round("score", 6)).select("query_id", "id", "score", "rank")


@query(f"WITH {SPARSE.format(n=1)} SELECT id, score, rank::INT AS rank FROM sparse")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    t = vectors.postings(tables(spark, d, "documents"))
    return vectors.sparse_scores(t, t.where("id < 1").withColumnRenamed("id", "query_id")).select("id", "score", "rank")


def hybrid(spark: SparkSession, d: str, n: int) -> DataFrame:
    t = vectors.postings(tables(spark, d, "documents"))
    return vectors.hybrid_search(dense_points(spark, d), t, query_vectors(spark, d, n), t.where(F.col("id") < n).withColumnRenamed("id", "query_id"))


@query(f"WITH {DENSE.format(n=1)}, {SPARSE.format(n=1)}, {FUSED} SELECT id, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d, 1).select("id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {DENSE.format(n=10)}, {SPARSE.format(n=10)}, {FUSED} SELECT query_id, id, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def hybrid_rrf_batch(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d, 10).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


# every row whose id is divisible by 20 is a query
EVERY_DENSE, EVERY_SPARSE = DENSE.replace("q.vec_id < {n}", "q.vec_id % 20 = 0"), SPARSE.replace("q.id < {n}", "q.id % 20 = 0")


def every_query(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query vectors, tokens of all documents, tokens of queries)."""
    q, t = tables(spark, d, "embeddings").where("vec_id % 20 = 0"), stored(vectors.postings(tables(spark, d, "documents")))
    return q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), t, t.where("id % 20 = 0").withColumnRenamed("id", "query_id")


@query(f"WITH {EVERY_DENSE} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM dense")
def dense_topk_every(spark: SparkSession, d: str) -> DataFrame:
    asked = tables(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.dense_scores(dense_points(spark, d), asked).withColumn("score", F.round("score", 6)).select("query_id", "id", "score", "rank")


@query(f"WITH {EVERY_SPARSE} SELECT query_id, id, score, rank::INT AS rank FROM sparse")
def sparse_topk_every(spark: SparkSession, d: str) -> DataFrame:
    return vectors.sparse_scores(*every_query(spark, d)[1:]).select("query_id", "id", "score", "rank")


@query(f"WITH {EVERY_DENSE}, {EVERY_SPARSE}, {FUSED} SELECT query_id, id, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def hybrid_rrf_every(spark: SparkSession, d: str) -> DataFrame:
    q, t, own = every_query(spark, d)
    return vectors.hybrid_search(dense_points(spark, d), t, q, own).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("""SELECT s_suppkey, replace(replace(regexp_replace(translate(lower(trim(s_name) || '__щука_жар'), 'укаар', 'ukaar'), '_+', '_', 'g'), 'щ', 'shch'), 'ж', 'zh') AS match_id FROM supplier""")
def translit_ids(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "supplier").select("s_suppkey", T.match_id(F.concat(F.lit(" "), "s_name", F.lit("__щука_жар "))).alias("match_id"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(CASE WHEN greatest(length(a.n_name), length(b.n_name)) = 0 THEN 1.0 ELSE
    len([i FOR i IN range(1, least(length(a.n_name), length(b.n_name)) + 1) IF substr(a.n_name, i, 1) = substr(b.n_name, i, 1)])::DOUBLE / greatest(length(a.n_name), length(b.n_name)) END, 6)::DOUBLE AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def positional_similarity(spark: SparkSession, d: str) -> DataFrame:
    n = tables(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", F.round(T.positional_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'nation_' || s_nationkey WHEN 1 THEN 'nation_' || s_nationkey || '_x' WHEN 2 THEN 'nution_' || (s_nationkey + 10) ELSE 'q' || s_suppkey END AS id, s_name FROM supplier),
    n AS (SELECT n_nationkey AS pos, 'nation_' || n_nationkey AS id, n_name FROM nation),
    p AS (SELECT s_suppkey, n.pos, n.n_name, (s.id = n.id) AS same, CASE WHEN contains(s.id, n.id) OR contains(n.id, s.id) THEN least(length(s.id), length(n.id)) ELSE 0 END AS inside,
        len([i FOR i IN range(1, least(length(s.id), length(n.id)) + 1) IF substr(s.id, i, 1) = substr(n.id, i, 1)])::DOUBLE / greatest(length(s.id), length(n.id)) AS sim FROM s, n),
    b AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY same DESC, inside DESC, CASE WHEN inside > 0 THEN 0 ELSE -sim END, pos) AS k FROM p WHERE same OR inside > 0 OR sim > 0.8)
    SELECT s.s_suppkey, coalesce(b.n_name, s.s_name || ' supplier') AS full_text, b.n_name IS NOT NULL AS text_found FROM s LEFT JOIN b ON b.s_suppkey = s.s_suppkey AND k = 1""")
def fuzzy_match_join(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey")
    i = F.when(k == 0, F.concat(F.lit("nation__"), n.cast("string"))).when(k == 1, F.concat(F.lit("Nation_"), n.cast("string"), F.lit("_x"))).when(k == 2, F.concat(F.lit("nution_"), (n + 10).cast("string"))).otherwise(F.concat(F.lit("q"), F.col("s_suppkey").cast("string")))
    recs = tables(spark, d, "supplier").select("s_suppkey", i.alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("category"))
    texts = tables(spark, d, "nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("full_text"), F.col("n_nationkey").alias("pos"))
    return matching.match_texts(recs, texts).select("s_suppkey", "full_text", "text_found")


@query("""SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, count(url) AS urls FROM (SELECT 'documents' AS source, text FROM documents UNION ALL BY NAME SELECT 'conversations' AS source, text FROM conversations
    UNION ALL BY NAME SELECT 'pages' AS source, html AS text, url FROM pages) GROUP BY source""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        tables(spark, d, "documents").select(F.lit("documents").alias("source"), "text"), tables(spark, d, "conversations").select(F.lit("conversations").alias("source"), "text"),
        tables(spark, d, "pages").select(F.lit("pages").alias("source"), F.col("html").alias("text"), "url"),
    ]
    u = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return u.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"), F.count("url").alias("urls"))


@query("""SELECT doc_id, lower(substr(text, 1, 30)) AS name_lower, length(text)::INT AS content_length, contains(lower(substr(text, 1, 30)), 'водк') AS is_vodka, coalesce(lang, '') = 'ликёр' AS is_liqueur, coalesce(quality, 0)::INT AS quality
    FROM documents LEFT JOIN labels USING (doc_id)""")
def payload_projection(spark: SparkSession, d: str) -> DataFrame:
    docs = tables(spark, d, "documents").join(tables(spark, d, "labels"), "doc_id", "left")
    recs = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("int").alias("number"), F.substring("text", 1, 30).alias("name"), F.col("text").alias("content"), F.col("text").alias("full_text"), F.col("lang").alias("category"))
    p = store.payload(recs, "documents").select(F.col("number").cast("long").alias("doc_id"), "name_lower", "content_length", "is_vodka", "is_liqueur")
    return p.join(docs.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality")), "doc_id")


@query("""SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    old, new = e.where("event_id % 2 = 0"), e
    state = store.upsert(store.latest(old, ["user_id"], [F.col("ts"), F.col("event_id")]), new, ["user_id"], [F.col("ts"), F.col("event_id")])
    return state.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("""SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """The events of the earlier half of their time, then those of the later one, upserted into a table in parts."""
    e = tables(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    path = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    later = F.col("ts") >= F.lit(first + (last - first) / 2 if first else None)
    for name, batch in (("earlier", e.where(~F.coalesce(later, F.lit(False)))), ("later", e.where(later))):
        parts.upsert_parts(spark, path, batch, ["user_id"], [F.col("ts"), F.col("event_id")], name, 8)
    return parts.read_parts(spark, path).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT conv_id, turn, role, length(text)::INT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2")
def chat_memory_window(spark: SparkSession, d: str) -> DataFrame:
    return store.turns_in_memory(tables(spark, d, "conversations"), 2).select("conv_id", "turn", "role", F.char_length("text").alias("chars"))


@query("SELECT conv_id, turn, role, length(text)::INT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE text IS NOT NULL) WHERE k <= 2")
def chat_memory_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same memory kept by a stream over the conversations (a pattern names them, be they a file or a folder)."""
    at = f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}"
    turns = tables(spark, d, "conversations")
    stream = ingest.chat_stream(spark, f"{d}/conversations.parquet*", turns.schema.simpleString()[7:-1].replace(":", " "))
    memory.remember(stream, 2, f"{at}/table", f"{at}/checkpoint", parts=8).awaitTermination()
    return memory.memory(spark, f"{at}/table").select("conv_id", F.col("turn").cast(turns.schema["turn"].dataType).alias("turn"), "role", F.char_length("text").alias("chars"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'no content' WHEN length(text) < 400 THEN 'too short' END AS error FROM documents""")
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    good, bad = store.quarantined(tables(spark, d, "documents").select("doc_id", "text"), store.document_checks(400))
    return good.select("doc_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("doc_id", "error"))


@query("SELECT count(*) AS total, min(doc_id) AS first_number, max(doc_id) AS last_number FROM documents")
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return store.report(tables(spark, d, "documents").withColumnRenamed("doc_id", "number"))


@query(f"WITH {CHUNKS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM c GROUP BY doc_id")
def append_chunks(spark: SparkSession, d: str) -> DataFrame:
    return store.appended_text(chunks.chunked(tables(spark, d, "documents").select("doc_id", "text"), 200))


@query("SELECT doc_id, source AS producer, 'application/pdf' AS format, NULLIF(lang, '') AS document_id FROM documents")
def scan_metadata(spark: SparkSession, d: str) -> DataFrame:
    info, meta = F.create_map(F.lit("Producer"), F.lit("")), F.create_map(F.lit("pdf:producer"), F.col("source"), F.lit("xapmm:documentid"), F.col("lang"))
    m = chunks.scan_metadata(info, meta)
    return tables(spark, d, "documents").select("doc_id", *[m[k].alias(k) for k in ("producer", "format", "document_id")])
