"""Grouped statistics and searches over arrays of ingredients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingredient_stats(records: DataFrame, items_col: str = "ingredients", at_least: int = 2) -> DataFrame:
    """Use count and mean modern amount by name and unit, for those used at least twice; most used first, then by name.

    Partial aggregates run before the one shuffle; the mean is a decimal."""
    one = records.select(F.explode(items_col).alias("i")).where("i.name is not null")
    out = one.groupBy(F.col("i.name").alias("ingredient_name"), F.col("i.modern_unit").alias("unit")).agg(F.count("*").alias("usage_count"), F.avg(F.col("i.modern_amount").cast("decimal(38,10)")).alias("avg_amount"))
    return out.where(F.col("usage_count") >= at_least).select("ingredient_name", "usage_count", "avg_amount", "unit").orderBy(F.desc("usage_count"), "ingredient_name", "unit")


def search_by_element(records: DataFrame, term: str, items_col: str = "ingredients", literal: bool = False) -> DataFrame:
    """Rows whose items tell the term anywhere in their JSON, with the names that hold it (maybe none).

    ``%`` and ``_`` in the term are wildcards unless ``literal``."""
    if literal:
        low = F.lower(F.lit(term))
        hit = F.contains(F.lower(F.to_json(items_col)), low)
        names = F.filter(F.transform(items_col, lambda i: i["name"]), lambda n: F.contains(F.lower(n), low))
    else:
        hit = F.to_json(items_col).ilike(f"%{term}%")
        names = F.filter(F.transform(items_col, lambda i: i["name"]), lambda n: n.ilike(f"%{term}%"))
    return records.where(hit).select("id", "name", "recipe_number", names.alias("matching_ingredients")).orderBy("recipe_number")


def top_by_items(records: DataFrame, n: int = 5, items_col: str = "ingredients", id_col: str = "id") -> DataFrame:
    """The ``n`` rows with most items; ties by id. One bounded heap a task."""
    return records.withColumn("n_items", F.size(items_col)).orderBy(F.desc("n_items"), id_col).limit(n)


def category_histogram(records: DataFrame, category_col: str = "category") -> DataFrame:
    return records.groupBy(category_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), category_col)
