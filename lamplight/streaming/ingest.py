"""Streaming ingest: each micro-batch is upserted into a table of points in parts, latest wins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lamplight.streaming.parts import PARTS, read_parts, upsert_parts


def current(spark: SparkSession, path: str) -> DataFrame | None:
    have = read_parts(spark, path)
    return have.drop("part") if have is not None else None


def ingest(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], key: list[str], order: list[Column], parts: int = PARTS) -> StreamingQuery:
    """Start the query. A batch rewrites the parts of the table that its keys fall into and commits them together; a batch of the same query
    that is run again after its commit changes nothing. Parts that no commit of late names are cleared by ``parts.clear``."""
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def put(batch: DataFrame, batch_id: int) -> None:
        upsert_parts(batch.sparkSession, path, prepare(batch), key, order, f"{query}-{batch_id}", parts)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chat_stream(spark: SparkSession, path: str, schema: str = "conv_id long, turn long, role string, text string") -> DataFrame:
    """Chat turns as a stream of Parquet files."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("text").isNotNull())
