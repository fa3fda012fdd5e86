"""Schema drift: tolerant reads, upgrades and their status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.identifiers import topic_or_none
from threadmill.schema import MESSAGES, MISSING_DEFAULTS, SCHEMA_VERSIONS

AGGREGATED = (
    "chat_identifier",
    "topic_id",
    "message_id",
    "date",
    "sender_id",
    "sender_username",
    "text",
    "deleted",
)


def tolerant_scan(table: DataFrame, columns: tuple[str, ...] = AGGREGATED) -> DataFrame:
    """The named columns of a table of any age; a missing one gets its default.

    NULLs in a column that exists stay NULL.
    """
    return table.select(
        *(
            F.col(name)
            if name in table.columns
            else F.lit(MISSING_DEFAULTS.get(name)).cast(MESSAGES[name].dataType).alias(name)
            for name in columns
        )
    )


def schema_upgrade(table: DataFrame) -> DataFrame:
    """All message columns; old NULL topics become -1."""
    upgraded = tolerant_scan(table, tuple(f.name for f in MESSAGES))
    return upgraded.withColumn("topic_id", topic_or_none(F.col("topic_id")))


def schema_status(applied: DataFrame) -> DataFrame:
    """Per table: current and latest version, pending upgrades, up to date.

    `applied` has `table_name` and `version` (NULL for a table without any).
    The catalog of versions is a constant and becomes part of the plan.
    """
    latest = SCHEMA_VERSIONS[-1][0]
    current = F.coalesce(F.max("version"), F.lit(0)).cast("bigint")
    pending = F.concat_ws(
        ",", *(F.when(F.col("current_version") < v, F.lit(name)) for v, name, _ in SCHEMA_VERSIONS)
    )
    counts = [(F.col("current_version") < v).cast("bigint") for v, _, _ in SCHEMA_VERSIONS]
    return (
        applied.groupBy("table_name")
        .agg(current.alias("current_version"))
        .select(
            "table_name",
            "current_version",
            F.lit(latest).cast("bigint").alias("latest_version"),
            sum(counts[1:], counts[0]).alias("pending_count"),
            pending.alias("pending"),
            (F.col("current_version") >= latest).alias("up_to_date"),
        )
    )
