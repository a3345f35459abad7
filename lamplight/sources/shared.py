"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one that the session has set; without either, a local one on one machine and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lamplight-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def steps_folder(spark: SparkSession) -> str:
    """Where this application keeps the tables of its steps."""
    return f"{shared_folder(spark)}/steps-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """The rows through a Parquet table in the shared folder: computed once, read by column, and there when an executor is lost. It stays until ``release``."""
    path = f"{steps_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Delete the tables of this application's steps, once no result that reads them is wanted any more; whether there were any."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(steps_folder(spark))
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))
