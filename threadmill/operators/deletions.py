"""Deletion marking and scan checkpoints.

A *scope* is one (chat, topic) that was scanned: columns `chat_identifier`,
`topic_id`, `cutoff` (the horizon the scan reached), `run_ts` and
`scan_complete`.  Scopes and checkpoints are joined without a hint: Spark
broadcasts them while they are small and falls back to a sort-merge join, with
its splitting of skewed partitions, when they are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.operators.filters import since, visible
from threadmill.schema import KEY, SCOPE


def seen_ids(*passes: DataFrame) -> DataFrame:
    """Distinct keys over all scan passes."""
    keys = passes[0].select(*KEY)
    for other in passes[1:]:
        keys = keys.unionByName(other.select(*KEY))
    return keys.distinct()


def missing_messages(
    messages: DataFrame, seen: DataFrame, scopes: DataFrame, earliest: object | None = None
) -> DataFrame:
    """Live messages inside a completely scanned window that the scan did not see.

    A scope that saw nothing marks nothing.  The window is the one the scan
    really covered.  `earliest`, a bound under all cutoffs, lets the file scan
    skip older data.  Adds `run_ts`.
    """
    if earliest is not None:
        messages = since(messages, earliest)
    productive = seen.select(*SCOPE).distinct()
    scanned = scopes.where("scan_complete").join(productive, list(SCOPE), "left_semi")
    return (
        visible(messages, include_service=True)
        .join(scanned.select(*SCOPE, "cutoff", "run_ts"), list(SCOPE))
        .where("date >= cutoff")
        .drop("cutoff")
        .join(seen.select(*KEY), list(KEY), "left_anti")
    )


def deletion_rows(missing: DataFrame) -> DataFrame:
    """Missing messages as they must be stored, with `change_type`."""
    return missing.withColumns(
        {"deleted": F.lit(1), "updated_at": F.col("run_ts"), "change_type": F.lit("delete")}
    ).drop("run_ts")


def mark_deleted(
    messages: DataFrame, seen: DataFrame, scopes: DataFrame, earliest: object | None = None
) -> DataFrame:
    """The whole table with missing messages marked as deleted."""
    missing = missing_messages(messages, seen, scopes, earliest)
    marks = missing.select(*KEY, F.col("run_ts").alias("_run"))
    gone = F.col("_run").isNotNull()
    joined = messages.join(marks, list(KEY), "left")
    return joined.select(
        *(
            {
                "deleted": F.when(gone, F.lit(1)).otherwise(F.col("deleted")).alias("deleted"),
                "updated_at": F.coalesce("_run", "updated_at").alias("updated_at"),
            }.get(c, F.col(c))
            for c in messages.columns
        )
    )


def checkpoint_update(checkpoints: DataFrame, scopes: DataFrame, seen: DataFrame) -> DataFrame:
    """Checkpoints after a run: the highest id seen, never moving backwards.

    Scopes whose scan was cut short keep their checkpoint.
    """
    highest = seen.groupBy(*SCOPE).agg(F.max("message_id").alias("_seen"))
    ran = scopes.where("scan_complete").select(*SCOPE, "run_ts").join(highest, list(SCOPE), "left")
    return checkpoints.join(ran, list(SCOPE), "full_outer").select(
        *SCOPE,
        F.greatest(F.coalesce("last_message_id", F.lit(0)), F.coalesce("_seen", F.lit(0))).alias(
            "last_message_id"
        ),
        F.coalesce("run_ts", "last_run_ts").alias("last_run_ts"),
    )
