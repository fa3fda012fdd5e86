"""Several sources into one table of unique posts, and automatic merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.operators.aggregate import (
    counters_of,
    kept_rows,
    merge_groups,
    places_of,
    posts_of,
    source_register,
)
from threadmill.operators.versions import crowded_keys, fold_versions
from threadmill.schema import KEY, MESSAGES
from threadmill.sinks.shared import settled


@dataclass(frozen=True)
class Aggregate:
    """Tables of an aggregation, lazy but for the rows they share."""

    posts: DataFrame
    sources: DataFrame
    post_sources: DataFrame
    counters: DataFrame


def aggregate_sources(
    sources: DataFrame,
    mode: str = "text",
    include_deleted: bool = False,
    given: DataFrame | None = None,
) -> Aggregate:
    """All tables from rows that are cleaned and hashed once, and written to the
    shared folder.  `given` lists the sources, if some may have no rows."""
    kept = settled(kept_rows(sources, mode, include_deleted))
    return Aggregate(
        posts=posts_of(kept),
        sources=source_register(sources, given),
        post_sources=places_of(kept),
        counters=counters_of(sources, kept),
    )


def merge_by_chat(sources: DataFrame) -> DataFrame:
    """Merge the sources of every chat that has at least two; `merged_into` says
    which chat's table a row belongs to.

    All chats at once.  A source goes into the table of its own chat with all
    its rows, so that chat is part of the key.  The groups, one row per source,
    are computed first.
    """
    chosen = settled(
        merge_groups(sources).select("source_name", F.col("chat_identifier").alias("merged_into"))
    )
    rows = sources.join(chosen, "source_name").select(*MESSAGES.names, "source_order", "merged_into")
    keys = ("merged_into", *KEY)
    merged = fold_versions(rows, hot=crowded_keys(rows, keys=keys), keys=keys)
    return merged.select("merged_into", *MESSAGES.names)
