"""Constraint checks and the health report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.identifiers import topic_or_none
from threadmill.schema import KEY

REQUIRED = (*KEY, "date")


def _null_count(column: str):
    return F.count_if(F.col(column).isNull())


def not_null_violations(messages: DataFrame) -> DataFrame:
    """Number of NULLs per required column, in one pass."""
    return messages.agg(*(_null_count(c).alias(f"null_{c}") for c in REQUIRED))


def duplicate_keys(messages: DataFrame) -> DataFrame:
    """Keys held by more than one row; a missing topic counts as -1."""
    normal = messages.withColumn("topic_id", topic_or_none(F.col("topic_id")))
    return normal.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def broken_references(post_sources: DataFrame, posts: DataFrame, sources: DataFrame) -> DataFrame:
    """References of `post_sources` that lead nowhere: (reference, value, rows).

    References are counted before they are looked up, so a post with very many
    places is one row in the join.
    """

    def dangling(column: str, target: DataFrame, key: str) -> DataFrame:
        counted = (
            post_sources.where(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        found = target.select(F.col(key).alias("value"))
        return counted.join(found, "value", "left_anti").select(
            F.lit(column).alias("reference"), "value", "rows"
        )

    return dangling("post_id", posts, "dedupe_hash").unionByName(
        dangling("source_name", sources, "source_name")
    )


def health_report(sources: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Per source: status, message count, date range and constraint violations.

    One pass: counting per key first finds the duplicates, and the rest of the
    report is summed up from those counts.  Sources that `given` lists by
    `source_name` and that have no rows are healthy, with zero messages.
    """
    normal = sources.withColumn("topic_id", topic_or_none(F.col("topic_id")))
    incomplete = F.col("chat_identifier").isNull() | F.col("message_id").isNull() | F.col("date").isNull()
    by_key = normal.groupBy("source_name", *KEY).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("earliest"),
        F.max("date").alias("latest"),
        F.count_if(incomplete).alias("nulls"),
    )
    report = by_key.groupBy("source_name").agg(
        F.sum("rows").alias("message_count"),
        F.min("earliest").alias("earliest_date"),
        F.max("latest").alias("latest_date"),
        F.sum("nulls").alias("incomplete_rows"),
        F.count_if(F.col("rows") > 1).alias("duplicate_keys"),
    )
    if given is not None:
        listed = given.select("source_name").distinct()
        counts = ["message_count", "incomplete_rows", "duplicate_keys"]
        report = report.join(listed, "source_name", "full_outer").fillna(0, counts)
    return report.withColumn(
        "status",
        F.when((F.col("incomplete_rows") == 0) & (F.col("duplicate_keys") == 0), "healthy").otherwise(
            "warning"
        ),
    )
