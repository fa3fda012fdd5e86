"""Table statistics and profiles; partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.times import month


def table_stats(messages: DataFrame) -> DataFrame:
    """Number of messages, earliest and latest date."""
    return messages.agg(
        F.count(F.lit(1)).alias("count"),
        F.min("date").alias("earliest"),
        F.max("date").alias("latest"),
    )


def listed_chats(messages: DataFrame, limit: int = 10) -> DataFrame:
    """The first chats and topics by name, `limit` of them as the report shows."""
    pairs = messages.select("chat_identifier", "topic_id").distinct()
    return pairs.orderBy("chat_identifier", "topic_id").limit(limit)


def chat_profile(messages: DataFrame) -> DataFrame:
    """Per chat, its latest message id and the month of its earliest message."""
    return messages.groupBy("chat_identifier").agg(
        F.max("message_id").alias("latest_message_id"),
        month(F.min("date")).alias("earliest_month"),
    )
