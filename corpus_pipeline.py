"""A training-data pipeline of corpus operators: each stage works on all rows that its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamplight.llm.common import checkpoint_dir, table
from lamplight.llm.exact_dedup import drop_exact_copies
from lamplight.llm.mixing import mixed_rows
from lamplight.llm.near_dedup import drop_near_copies
from lamplight.llm.piece_fst import encode_pieces
from lamplight.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id."""
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of smaller sources again as their weights ask for; copies carry their doc_id."""
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text."""
    return encode_pieces(docs)


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixing", mixed), ("pieces", pieces)]

#: Scores of a trained model cannot be had in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again for the next."""
    import uuid

    where = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{where}/{k}-{name}")
        docs = spark.read.parquet(out)
    return docs
