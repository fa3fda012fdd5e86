"""Message tables: projection, and scans over several sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.functions.identifiers import topic_or_none
from threadmill.operators.evolution import schema_upgrade
from threadmill.schema import EXPORT_COLUMNS, MESSAGES, MISSING_DEFAULTS


def scan_project(messages: DataFrame) -> DataFrame:
    """The 13 named columns, without the surrogate id."""
    return messages.select(*EXPORT_COLUMNS)


def tag_source(table: DataFrame, order: int, name: str, path: str) -> DataFrame:
    return table.withColumns(
        {
            "source_order": F.lit(order),
            "source_name": F.lit(name),
            "source_path": F.lit(path),
        }
    )


def multi_source_scan(sources: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """Rows of (name, path, table) sources, tagged and numbered in the given order.

    Tables of any age: missing columns get their defaults.
    """
    tagged = [
        tag_source(schema_upgrade(table), i, name, path)
        for i, (name, path, table) in enumerate(sources)
    ]
    return reduce(DataFrame.unionByName, tagged)


def read_sources(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """The same from Parquet tables given as (name, path)."""
    return multi_source_scan([(n, p, spark.read.parquet(p)) for n, p in sources])


def given_sources(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """The list itself, numbered in the given order, whether or not a source has rows."""
    rows = [(name, path, i) for i, (name, path) in enumerate(sources)]
    return spark.createDataFrame(rows, "source_name string, source_path string, source_order int")


def read_source_folders(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """The same from one folder per source, `<root>/source_name=<name>/`, as a
    single scan however many there are.

    Sources are numbered as in `names`; others under `root` are not read.
    Columns an older table lacks are NULL in the scan and then get their defaults.
    """
    schema = T.StructType([*MESSAGES.fields, T.StructField("source_name", T.StringType())])
    numbered = spark.createDataFrame(
        [(name, order) for order, name in enumerate(names)], "source_name string, source_order int"
    )
    rows = spark.read.schema(schema).parquet(root).where(F.col("source_name").isin(list(names)))
    folder = F.concat(F.lit(root.rstrip("/") + "/source_name="), "source_name")
    return (
        rows.join(numbered, "source_name")
        .withColumn("topic_id", topic_or_none(F.col("topic_id")))
        .withColumn("deleted", F.coalesce("deleted", F.lit(MISSING_DEFAULTS["deleted"])))
        .select(*MESSAGES.names, "source_order", "source_name", folder.alias("source_path"))
    )
