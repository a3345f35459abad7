"""Writing records and points: stable keys, defaults, quarantine, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lamplight.operators.ingredients import SCHEMA


def point_id(*parts: Column) -> Column:
    """A key that a repeated run gives again."""
    return F.xxhash64(*parts)


def quarantined(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``error``): the first check that does not hold names the error. Nothing is dropped."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = df.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def document_checks(shortest: int = 100) -> dict[str, Column]:
    return {"no content": F.col("text").isNotNull() & (F.col("text") != ""), "too short": F.char_length("text") >= shortest}


def vector_checks(dims: int, column: str = "dense") -> dict[str, Column]:
    """What makes a vector fit for the index; for ``quarantined``."""
    v = F.col(column)
    return {
        "no vector": v.isNotNull() & (F.size(v) > 0),
        "wrong length": F.size(v) == dims,
        "not a number": F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))),
        "zero vector": F.exists(v, lambda x: x != 0),
    }


def json_row(rows: DataFrame, columns: tuple[str, ...] = ("ingredients", "ingredients_per_liter", "historical_measures")) -> DataFrame:
    """Nested columns as JSON texts, for stores without arrays; null stays null."""
    return rows.withColumns({c: F.to_json(c) for c in columns if c in rows.columns})


def create_table(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """An empty table of the columns of ``rows``, in place of what was there."""
    rows.limit(0).write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def table_rows(records: DataFrame, source_type: str = "historical", most_text: int = 5000) -> DataFrame:
    """Records as rows of the recipes table: key, defaults, stored text cut to its column's size."""
    now = F.current_timestamp()
    return records.select(
        point_id(F.lit(source_type), F.coalesce(F.col("number").cast("string"), F.lit("")), "name").alias("id"), F.col("number").alias("recipe_number"), "name",
        F.coalesce("ingredients", F.array().cast(SCHEMA)).alias("ingredients"), F.col("ingredients_per_liter"), "description", F.substring("content", 1, most_text).alias("original_text"),
        F.lit(source_type).alias("source_type"), "historical_measures", F.lit(None).cast("decimal(5,2)").alias("alcohol_content"), F.lit(None).cast("string").alias("preparation_method"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> dict[str, int]:
    """Write good rows and put bad ones beside them, a job each over the rows; counts of both are observed as they are written. Row groups are sorted by number."""
    good, bad = quarantined(rows, {"no name": F.col("name").isNotNull(), "no ingredients": F.col("ingredients").isNotNull()})
    a, b = Observation("good"), Observation("bad")
    good.observe(a, F.count("*").alias("n")).sortWithinPartitions("recipe_number").write.mode(mode).partitionBy("source_type").parquet(f"{path}/rows")
    bad.observe(b, F.count("*").alias("n")).write.mode(mode).parquet(f"{path}/errors")
    return {"success": a.get["n"], "error": b.get["n"]}


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the last in order: the state after upserts in that order. A partial aggregate keeps one row of a
    key per task, so a hot key is combined before the shuffle. Columns of any type; ties go by a hash of the row's JSON."""
    rest = [c for c in df.columns if c not in key]
    rows = F.struct(*[F.col(c) for c in rest])
    best = df.groupBy(*key).agg(F.max_by(rows, F.struct(*[o.alias(f"__o{k}") for k, o in enumerate(order)], F.xxhash64(F.to_json(rows)).alias("__tie"))).alias("__best"))
    return best.select(*key, *[F.col(f"__best.{c}").alias(c) for c in rest])


def upsert(existing: DataFrame | None, new: DataFrame, key: list[str], order: list[Column], at: str = "updated_at") -> DataFrame:
    """The table after the new rows: latest wins, ``updated_at`` set anew where a row is replaced."""
    if existing is None:
        return latest(new, key, order)
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    out = latest(both, key, [F.col("__new"), *order])
    if at in out.columns:
        out = out.withColumn(at, F.when(F.col("__new") == 1, F.current_timestamp()).otherwise(F.col(at)))
    return out.drop("__new")


#: Columns of a point's payload by the source it is made for; the rest of ``payload`` is common to all.
VARIANTS = {
    "vodka": ("is_vodka", "is_rozolia", "is_ratafia", "vector_dimension", "sparse_token_count"),
    "liqueur": ("is_vodka", "is_liqueur"),
    "tincture": ("french_name", "original_paragraph", "vector_dimension", "sparse_token_count"),
    "structured": ("ingredients_count", "process_steps"),
    "legacy": ("is_vodka", "is_liqueur", "source_pattern", "source_book"),
}


def variant_payload(records: DataFrame, source: str, variant: str) -> DataFrame:
    """The payload of one of VARIANTS. Its columns come from the records where they have them; missing numbers are 0, missing texts empty."""
    own = VARIANTS[variant]
    base = payload(records, source)
    flags = [c for c in own if c in base.columns]
    common = [c for c in base.columns if c not in ("is_vodka", "is_rozolia", "is_ratafia", "is_liqueur")]
    given = {c: records[c] for c in own if c not in flags and c in records.columns}
    number = ("vector_dimension", "sparse_token_count", "ingredients_count", "process_steps", "original_paragraph")
    # taken along in one select, so that rows are never joined back
    carried = payload(records, source, {c: F.coalesce(given[c].cast("int"), F.lit(0)) if c in number else F.coalesce(given[c].cast("string"), F.lit("")) for c in given})
    missing = {c: F.lit(0) if c in number else F.lit("") for c in own if c not in flags and c not in given}
    return carried.withColumns(missing).select(*common, *own) if missing else carried.select(*common, *own)


def payload(records: DataFrame, source: str, more: dict[str, Column] | None = None) -> DataFrame:
    """What a point carries beside its vectors; missing values take their defaults."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = F.lower(text("name"))
    return records.select(
        point_id(F.lit(source), text("id"), F.coalesce(F.col("number").cast("string"), F.lit(""))).alias("point_id"), text("id").alias("recipe_id"), F.coalesce("number", F.lit(0)).alias("number"),
        text("name").alias("name"), name.alias("name_lower"), text("content").alias("content"), text("full_text").alias("full_text"), text("category").alias("category"),
        F.coalesce(F.char_length("content"), F.lit(0)).alias("content_length"), name.contains("водк").alias("is_vodka"), name.contains("розоли").alias("is_rozolia"), name.contains("ратафи").alias("is_ratafia"),
        (F.coalesce(F.col("category"), F.lit("")) == "ликёр").alias("is_liqueur"), F.lit(source).alias("source"), F.current_timestamp().alias("created_at"),
        *[c.alias(k) for k, c in (more or {}).items()],
    )


def vector_sizes(points: DataFrame, dense: str = "dense", sparse: str = "sparse_indices") -> DataFrame:
    """Adds vector_dimension and sparse_token_count, 0 where there is no vector."""
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return points.withColumns({"vector_dimension": size(dense), "sparse_token_count": size(sparse)})


def sparse_flags(df: DataFrame, spaces: tuple[str, ...] = ("ingredients", "spices_herbs", "techniques", "measurements")) -> DataFrame:
    return df.withColumns({f"has_{s}": F.map_contains_key("sparse", s) for s in spaces} | {"sparse_categories": F.map_keys("sparse")})


def turns_in_memory(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def report(records: DataFrame) -> DataFrame:
    """Totals for a console report: rows, least and greatest number."""
    return records.agg(F.count("*").alias("total"), F.min("number").alias("first_number"), F.max("number").alias("last_number"))


def appended_text(chunks: DataFrame) -> DataFrame:
    """Chunks of each document put together again in their order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("doc_id").agg(parts.alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
