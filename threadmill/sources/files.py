"""Catalogs of stored files and source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed value: names that mark copies, in any case -----------------------------
NOT_A_SOURCE = r"(?i)backup|archive"
# ---------------------------------------------------------------------------------


def file_catalog(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, path, modification time and size of the files under `path`.

    File contents are pruned from the scan and never read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select(
        F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"),
        "path",
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("bytes"),
        F.round(F.col("length") / 1048576, 2).alias("size_mb"),
    )


def source_catalog(named: DataFrame, column: str = "source_name") -> DataFrame:
    """Distinct source names in order, without backups and archives."""
    usable = named.where(~F.col(column).rlike(NOT_A_SOURCE))
    return usable.select(column).distinct().orderBy(column)
