"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new path under `spark.checkpoint.dir`.

    Where none is set, a local session takes a temporary folder; on a cluster
    that would be a different folder on every machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="threadmill-")
    return f"{folder}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """`df` written out and read back.

    For a part of a run that is used several times or joined to a large table.
    Its lineage ends here, losing an executor does not bring it back, and Spark
    knows its true size: a join with it is a broadcast exactly if it is small,
    without shuffling the large side first to find out.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
