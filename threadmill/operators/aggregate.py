"""Unique posts across sources, with their lineage.

Rows come from a tagged scan: message columns plus `source_name`,
`source_path` and `source_order`.  The hash of a post is its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.identifiers import topic_or_none
from threadmill.functions.text import dedupe_hash, normalize_text
from threadmill.operators.arrival import arrival, tie
from threadmill.operators.filters import has_words, visible


def kept_rows(sources: DataFrame, mode: str = "text", include_deleted: bool = False) -> DataFrame:
    """Rows that count as posts, `text` normalised, with `dedupe_hash`."""
    rows = visible(sources, include_deleted, include_service=True).where(has_words(F.col("text")))
    rows = rows.withColumn("text", normalize_text(F.col("text")))
    digest = dedupe_hash(
        F.col("text"), F.col("sender_id"), F.col("sender_username"), F.col("date"), mode
    )
    return rows.withColumn("dedupe_hash", digest)


def posts(sources: DataFrame, mode: str = "text", include_deleted: bool = False) -> DataFrame:
    """:func:`posts_of` the rows that count."""
    return posts_of(kept_rows(sources, mode, include_deleted))


def posts_of(kept: DataFrame) -> DataFrame:
    """One row per hash of :func:`kept_rows`: text, sender and `first_date` of the
    first row to arrive (not the earliest), and the latest date.

    `last_date` starts from the first row's date and only moves forward, so it
    stays NULL if that one is NULL.
    """
    arrived = F.struct("text", "date", "sender_id", "sender_username")
    return (
        kept.groupBy("dedupe_hash")
        .agg(
            F.min_by(arrived, arrival(kept)).alias("first"), F.max("date").alias("latest")
        )
        .select(
            "dedupe_hash",
            F.col("first.text").alias("text"),
            F.col("first.date").alias("first_date"),
            F.when(F.col("first.date").isNotNull(), F.col("latest")).alias("last_date"),
            F.col("first.sender_id").alias("sender_id"),
            F.col("first.sender_username").alias("sender_username"),
        )
    )


def post_sources(sources: DataFrame, mode: str = "text", include_deleted: bool = False) -> DataFrame:
    """:func:`places_of` the rows that count."""
    return places_of(kept_rows(sources, mode, include_deleted))


def places_of(kept: DataFrame) -> DataFrame:
    """Where each post of :func:`kept_rows` was found; the first row per place
    gives the date.

    A row without chat or message id is never the same place as another one:
    such rows are not aggregated.
    """
    rows = kept.withColumn("topic_id", topic_or_none(F.col("topic_id")))
    nowhere = F.col("chat_identifier").isNull() | F.col("message_id").isNull()
    place = ["dedupe_hash", "source_name", "chat_identifier", "topic_id", "message_id"]
    found = rows.where(~nowhere).groupBy(*place).agg(F.min_by("date", arrival(rows)).alias("date"))
    apart = rows.where(nowhere).select(*place, "date")
    return found.unionByName(apart).select(F.col("dedupe_hash").alias("post_id"), *place[1:], "date")


def source_register(sources: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """One row per source name; the first path given for it stays.

    `given` lists the sources (`source_name`, `source_path`, `source_order`), as
    :func:`~threadmill.sources.tables.given_sources` does: those without rows are
    registered too, and no row is read.
    """
    listed = (sources if given is None else given).select("source_name", "source_path", "source_order")
    return listed.groupBy("source_name").agg(
        F.min_by("source_path", F.struct("source_order", "source_path")).alias("source_path")
    )


def aggregate_counters(
    sources: DataFrame, mode: str = "text", include_deleted: bool = False
) -> DataFrame:
    """Rows read, rows kept before deduplication, unique posts (exact)."""
    text, username = normalize_text(F.col("text")), F.col("sender_username")
    digest = dedupe_hash(text, F.col("sender_id"), username, F.col("date"), mode)
    live = F.lit(True) if include_deleted else F.coalesce("deleted", F.lit(0)) == 0
    kept = live & has_words(F.col("text"))
    return _counted(sources.select(F.when(kept, digest).alias("post"), F.lit(1).alias("read")))


def counters_of(sources: DataFrame, kept: DataFrame) -> DataFrame:
    """The same, where the rows kept have been hashed already: `sources` are only counted."""
    read = sources.agg(F.count(F.lit(1)).alias("read")).select(F.lit(None).cast("string").alias("post"), "read")
    return _counted(read.unionByName(kept.select(F.col("dedupe_hash").alias("post"), F.lit(0).alias("read"))))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.coalesce(F.sum("read"), F.lit(0)).alias("rows_read"),
        F.count("post").alias("rows_kept"),
        F.count_distinct("post").alias("unique_posts"),
    )


def merge_groups(sources: DataFrame) -> DataFrame:
    """Sources to be merged: those whose chat at least one more source has.

    A source belongs to the chat of its first row by id, whatever that is; rows
    without ids come first, ordered by what else they hold.  One row per source,
    with the number of sources of its chat.

    The first ids are found from two columns; only rows that have them are looked at whole.
    """
    first_id = F.coalesce("id", F.lit(-(2**63)))
    lowest = sources.groupBy(F.col("source_name").alias("_name")).agg(F.min(first_id).alias("_first"))
    same = F.col("source_name").eqNullSafe(F.col("_name")) & (first_id == F.col("_first"))
    by_source = (
        sources.join(lowest, same)
        .groupBy("source_name")
        .agg(F.min_by("chat_identifier", tie(sources.columns)).alias("chat_identifier"))
    )
    sizes = (
        by_source.groupBy("chat_identifier")
        .agg(F.count(F.lit(1)).alias("source_count"))
        .where("source_count >= 2")
    )
    return by_source.join(sizes, "chat_identifier").select(
        "chat_identifier", "source_name", "source_count"
    )
