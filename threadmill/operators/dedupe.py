"""First-wins deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.operators.arrival import tie
from threadmill.functions.identifiers import topic_or_none
from threadmill.functions.text import clean_text, dedupe_hash, normalize_text
from threadmill.functions.times import second_of
from threadmill.operators.filters import computed_once, has_text, visible, worth_exporting
from threadmill.schema import KEY


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """Per key, the row that comes first.  `order` must not leave ties.

    An aggregate, not a ranking: rows of a key that many share (an empty text)
    shrink to one per task before the shuffle.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    kept = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("kept")
    return df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(named))).agg(kept).select("kept.*")


def chronological() -> list[Column]:
    """The order of exports; id settles ties, the key does where there is no id."""
    return [second_of(F.col("date")), F.col("id"), *(F.col(c) for c in KEY)]


def dedupe_min_id(messages: DataFrame) -> DataFrame:
    """The row with the lowest id per key; a missing topic counts as -1."""
    normal = messages.withColumn("topic_id", topic_or_none(F.col("topic_id")))
    return first_wins(normal, KEY, [F.col("id"), tie(normal.columns)])


def dedupe_csv(messages: DataFrame, mode: str = "text") -> DataFrame:
    """Chronologically first row per normalised text (and sender, day).

    Deleted, service and empty messages take part; all empty texts are one.
    """
    digest = dedupe_hash(
        normalize_text(F.col("text")),
        F.col("sender_id"),
        F.col("sender_username"),
        F.col("date"),
        mode,
        null_sender="None",
    )
    return first_wins(messages, [digest], chronological())


def candidates(
    messages: DataFrame, include_deleted: bool = False, include_service: bool = False
) -> DataFrame:
    """Messages that may be exported, by what the file scan can check."""
    return visible(messages, include_deleted, include_service).where(has_text(F.col("text")))


def cleaned(rows: DataFrame, min_chars: int = 0, skip_hashtag_only: bool = False) -> DataFrame:
    """Rows with `text` cleaned, without those that are then too short or only tags.

    A text of white space only is kept as '' unless `min_chars` forbids it.
    """
    clean = clean_text(F.col("text"))
    if not (min_chars or skip_hashtag_only):
        return rows.withColumn("text", clean)
    return computed_once(rows, "text", clean).where(
        worth_exporting(F.col("text"), min_chars, skip_hashtag_only)
    )


def dedupe_jsonl(rows: DataFrame, mode: str = "text") -> DataFrame:
    """Chronologically first row per cleaned text (and sender, day) of
    :func:`cleaned` rows."""
    digest = dedupe_hash(
        F.col("text"),
        F.col("sender_id"),
        F.col("sender_username"),
        F.col("date"),
        mode,
        null_sender="None",
    )
    return first_wins(rows, [digest], chronological())
