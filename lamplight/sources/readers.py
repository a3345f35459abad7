"""Document sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, source: str = "file") -> DataFrame:
    """One row per text file: doc_id, source, text, meta."""
    df = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return df.select(F.xxhash64("path").alias("doc_id"), F.lit(source).alias("source"), "text", F.create_map(F.lit("path"), F.col("path")).alias("meta"))


def fetch_text(url: str, to: str, opener: Callable[[str], bytes] | None = None) -> str:
    """Download an exported document to storage on the driver; an answer that is no success raises."""
    import urllib.request

    data = opener(url) if opener else urllib.request.urlopen(url, timeout=60).read()  # noqa: S310
    with open(to, "wb") as f:
        f.write(data)
    return to


def read_scans(spark: SparkSession, path: str, extract: Callable[[bytes], dict]) -> DataFrame:
    """Binary documents through a pluggable extractor: text, numpages, numrender, info, metadata."""
    schema = "doc_id long, path string, text string, numpages int, numrender int, info map<string,string>, metadata map<string,string>, error string"

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for i, p, content in zip(frame["doc_id"], frame["path"], frame["content"], strict=True):
                try:
                    x = extract(content)
                    rows.append((i, p, x.get("text") or "", x.get("numpages"), x.get("numrender"), x.get("info") or {}, x.get("metadata") or {}, None))
                except Exception as e:  # a document that cannot be read is a row with its error
                    rows.append((i, p, None, None, None, {}, {}, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "text", "numpages", "numrender", "info", "metadata", "error"])

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")
    return files.mapInPandas(run, schema)


STRUCTURED = """data struct<recipes: array<struct<id:string,name:string,category:string,year:int,quality:string,preparation:struct<description:string>,infusion_time:string,
ingredients:array<string>,infusion_ingredients:array<string>,process:array<string>>>, recipes_full_text: array<struct<id:string,full_text:string>>>"""


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """Structured records of JSON files, one row each with its ordinal, numeric features told."""
    df = spark.read.schema(STRUCTURED).json(path, multiLine=True).select(F.posexplode("data.recipes").alias("pos", "r")).select("pos", "r.*")
    return df.withColumn("ingredients_count", F.coalesce(F.size("ingredients"), F.lit(0)) + F.coalesce(F.size("infusion_ingredients"), F.lit(0))).withColumn("process_steps", F.coalesce(F.size("process"), F.lit(0)))


def read_full_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STRUCTURED).json(path, multiLine=True).select(F.posexplode("data.recipes_full_text").alias("pos", "r")).select("pos", "r.*")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probe(spark: SparkSession) -> DataFrame:
    """Whether the session answers."""
    return spark.sql("select current_timestamp() as now")
