"""Command line: records of text files, extracted, stored and reported."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lamplight.operators import ingredients, records, statistics, store
from lamplight.sources.readers import fetch_text, read_texts


#: Texts left out that are shown; the count tells of the rest.
SHOWN = 20


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lamplight", description=__doc__)
    p.add_argument("--file", help="a text file or a folder of them")
    p.add_argument("--url", help="an exported text to download first")
    p.add_argument("--out", help="where to store rows; without it, or with --test, three rows are shown")
    p.add_argument("-t", "--test", action="store_true", help="extract and show, store nothing")
    p.add_argument("-s", "--sql", action="store_true", help="print the stored table's columns")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lamplight").getOrCreate()
    if a.url:
        a.file = fetch_text(a.url, a.file or "download.txt")
    if not a.file:
        p.error("--file or --url is needed")
    good, bad = store.quarantined(read_texts(spark, a.file), store.document_checks())
    for r in bad.select("error", F.substring("text", 1, 100).alias("preview")).limit(SHOWN).collect():
        print(f"left out: {r.error}: {r.preview}")
    print(f"left out in all: {bad.count()}")
    rows = store.table_rows(ingredients.with_ingredients(records.main_records(good)))
    if a.sql:
        rows.printSchema()
    if a.test or not a.out:
        for r in rows.limit(3).collect():
            print(r.recipe_number, r.name, [(i.name, i.amount, i.unit) for i in r.ingredients])
        store.report(rows.withColumnRenamed("recipe_number", "number")).show()
        return 0
    print(store.write_table(rows, a.out))
    statistics.ingredient_stats(spark.read.parquet(f"{a.out}/rows")).show(10)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
