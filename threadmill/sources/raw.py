"""Landed raw records: reading and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions.identifiers import export_chat_name, export_chat_topic, topic_or_none
from threadmill.operators.filters import since
from threadmill.schema import LANDED, NO_TOPIC, SCOPE

# So many checkpoints become conditions of the file scan.
PUSHED_SCOPES = 64


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines, with the schema given, so that nothing is inferred."""
    return spark.read.schema(LANDED).json(path)


def flatten_raw(
    raw: DataFrame,
    run_ts: object,
    chat_id: Column | None = None,
    chat_identifier: Column | None = None,
    topic_id: Column | None = None,
) -> DataFrame:
    """Raw records as message rows.  Records without a date are dropped.

    Chat and topic come from the record itself unless given.
    """
    stamp = run_ts if isinstance(run_ts, Column) else F.lit(str(run_ts))
    chat_id = F.col("chat_id") if chat_id is None else chat_id
    chat = F.col("chat_identifier") if chat_identifier is None else chat_identifier
    topic = F.col("topic_id") if topic_id is None else topic_id
    return raw.where(F.col("date").isNotNull()).select(
        chat_id.cast("bigint").alias("chat_id"),
        chat.alias("chat_identifier"),
        topic_or_none(topic).alias("topic_id"),
        F.col("id").alias("message_id"),
        "date",
        "edit_date",
        "sender_id",
        F.col("sender.username").alias("sender_username"),
        F.coalesce("message", F.lit("")).alias("text"),
        "reply_to_msg_id",
        F.col("action").isNotNull().cast("int").alias("is_service"),
        F.lit(0).alias("deleted"),
        stamp.cast(raw.schema["date"].dataType).alias("updated_at"),
    )


def canonical_scope(messages: DataFrame) -> DataFrame:
    """Chat names without '@' or link, and the topic a link carries.

    Applied on the way in, so that a later filter by name finds its rows.
    """
    raw = F.col("chat_identifier")
    given = F.when(F.col("topic_id") != NO_TOPIC, F.col("topic_id"))
    topic = topic_or_none(F.coalesce(given, export_chat_topic(raw)))
    return messages.withColumns({"chat_identifier": export_chat_name(raw), "topic_id": topic})


def in_thread(raw: DataFrame, topic_id: int | None) -> DataFrame:
    """Records of one thread: replies to its root.  No topic means all records."""
    if topic_id is None or topic_id == NO_TOPIC:
        return raw
    return raw.where(F.col("reply_to_msg_id") == topic_id)


def above_checkpoints(messages: DataFrame, checkpoints: DataFrame, most: int = PUSHED_SCOPES) -> DataFrame:
    """`messages` without rows at or below the checkpoint of the `most` furthest scopes.

    One plain condition per scope, which the file scan uses to pass over row
    groups and files; ids grow with a chat, so these are the largest ones.  It
    only spares reading: the join with all checkpoints decides.
    """
    known = checkpoints.where("last_message_id > 0 AND chat_identifier IS NOT NULL")
    furthest = known.select(*SCOPE, "last_message_id").orderBy(
        F.desc("last_message_id"), *SCOPE
    ).limit(most)
    for chat, topic, last in furthest.collect():
        if topic is None:
            continue  # no row equals it, as topics of rows are never NULL in the join
        elsewhere = F.col("topic_id") != topic
        # A missing topic is NO_TOPIC, so it lies in that scope and outside the others.
        at = F.col("topic_id").isNotNull() & elsewhere if topic == NO_TOPIC else F.col("topic_id").isNull() | elsewhere
        other_chat = F.col("chat_identifier").isNull() | (F.col("chat_identifier") != chat)
        messages = messages.where(other_chat | at | (F.col("message_id") > last))
    return messages


def incremental_scan(
    messages: DataFrame, checkpoints: DataFrame | None = None, cutoff: object | None = None
) -> DataFrame:
    """Rows above the checkpoint of their chat and topic, dated since `cutoff`.

    Without a cutoff (backfill) only the checkpoint counts; without checkpoints
    too, it is a scan of the full history.  Late rows are cut by this plain
    filter; an event-time watermark would drop other rows.  The checkpoints of
    the largest scopes, read when this is called, reach the file scan.
    """
    if cutoff is not None:
        messages = since(messages, cutoff)
    if checkpoints is None:
        return messages
    last = checkpoints.select(*SCOPE, F.col("last_message_id").alias("_last"))
    rows = above_checkpoints(messages, checkpoints).withColumn("topic_id", topic_or_none(F.col("topic_id")))
    return (
        rows.join(last, list(SCOPE), "left")
        .where(F.col("message_id") > F.coalesce("_last", F.lit(0)))
        .select(*messages.columns)
    )


def edit_rescan(messages: DataFrame, edit_cutoff: object) -> DataFrame:
    """Rows young enough to be checked for edits again."""
    return since(messages, edit_cutoff)
