"""Contiguous shards of equal size in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import running_totals, settled, small_side

SHARDS = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Cut `docs` (doc_id, text) in the order of doc_id into `shards` shards.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard,
    slot (place in the shard, from 0), offset (bytes before) and rank (rows
    before).  A document belongs to the shard its middle byte falls into, so a
    shard misses the equal share by half a document at each end at most.

    A null text has no bytes and the checksum of an empty one.  Null ids come
    first; equal ids are ordered by size and checksum, and rows equal in these
    too have interchangeable places.  An empty table gives an empty one, a shard
    may be empty if there are few documents.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = settled(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    total = sized.agg(F.sum("size")).first()[0] or 1
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    middle = f"((2 * offset + size) * {shards}) div {2 * total}"
    placed = settled(
        running_totals(sized, order, "size").withColumn("shard", F.expr(middle).cast("int"))
    )
    firsts = settled(placed.groupBy("shard").agg(F.min("rank").alias("_first")))
    return placed.join(small_side(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("_first")).alias("slot"), "offset", "rank"
    )
