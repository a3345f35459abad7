"""The two table functions as temporary SQL functions of a session, over a view of records."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession, view: str = "drinks_recipes") -> None:
    """search_recipes_by_ingredient(term) and get_ingredient_statistics() over ``view``, which has ingredients as an array of structs."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION search_recipes_by_ingredient(ingredient_name STRING)
        RETURNS TABLE (id BIGINT, name STRING, recipe_number INT, matching_ingredients ARRAY<STRING>)
        RETURN SELECT r.id, r.name, r.recipe_number, filter(transform(r.ingredients, i -> i.name), n -> n ILIKE concat('%', ingredient_name, '%'))
        FROM {view} r WHERE to_json(r.ingredients) ILIKE concat('%', ingredient_name, '%')""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION get_ingredient_statistics()
        RETURNS TABLE (ingredient_name STRING, usage_count BIGINT, avg_amount DECIMAL(38,14), unit STRING)
        RETURN SELECT i.name, count(*), cast(avg(cast(i.modern_amount AS DECIMAL(38,10))) AS DECIMAL(38,14)), i.modern_unit
        FROM {view} LATERAL VIEW explode(ingredients) AS i WHERE i.name IS NOT NULL
        GROUP BY i.name, i.modern_unit HAVING count(*) > 1""")
