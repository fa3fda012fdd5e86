"""Row predicates, as columns over the messages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.text import WHITESPACE, hashtag_only
from threadmill.functions.times import moment
from threadmill.schema import COMPARED


def flag(column: Column) -> Column:
    """0/1/NULL to boolean."""
    return F.coalesce(column, F.lit(0)) != 0


def in_chat(
    messages: DataFrame, chat_identifier: str | None = None, topic_id: int | None = None
) -> DataFrame:
    """Optional chat and topic filters.  Topic -1 also finds a NULL topic."""
    if chat_identifier:
        messages = messages.where(F.col("chat_identifier") == chat_identifier)
    if topic_id is not None:
        same = F.col("topic_id") == topic_id
        # Only the no-topic filter has to look at NULLs; the others stay a
        # plain comparison that the file scan can use.
        messages = messages.where(same | F.col("topic_id").isNull() if topic_id == -1 else same)
    return messages


def visible(
    messages: DataFrame, include_deleted: bool = False, include_service: bool = False
) -> DataFrame:
    """Drop deleted and service messages unless asked for."""
    if not include_deleted:
        messages = messages.where(_unset("deleted"))
    if not include_service:
        messages = messages.where(_unset("is_service"))
    return messages


def _unset(name: str) -> Column:
    # Says the same as ~flag(), in a form the file scan can use.
    return (F.col(name) == 0) | F.col(name).isNull()


def has_text(text: Column) -> Column:
    """Neither NULL nor ''."""
    return text.isNotNull() & (text != "")


def has_words(text: Column) -> Column:
    """Something besides white space."""
    return text.rlike(rf"(?!{WHITESPACE})[\s\S]")


def computed_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Like withColumn, for a costly column that filters will use.

    The optimizer moves filters down and would evaluate the column there too;
    it does not move them past a generator.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(column)).alias(name)).select(*df.columns)


def worth_exporting(
    cleaned: Column, min_chars: int = 0, skip_hashtag_only: bool = False
) -> Column:
    """Length and hashtag rules over the *cleaned* text; length in code points."""
    keep = F.lit(True)
    if min_chars:
        keep = F.length(cleaned) >= min_chars
    if skip_hashtag_only:
        keep = keep & ~hashtag_only(cleaned)
    return keep


def since(df: DataFrame, cutoff: object, column: str = "date") -> DataFrame:
    """Rows dated at or after `cutoff`, which is always given, never the clock."""
    return df.where(F.col(column) >= moment(df, column, cutoff))


def _comparable(name: str, prefix: str = "") -> str:
    """SQL of a compared column with its NULL replaced by what NULL stands for."""
    stand_in = COMPARED[name]
    return f"{prefix}{name}" if stand_in is None else f"coalesce({prefix}{name}, {stand_in!r})"


def content() -> Column:
    """The compared columns as one struct; two versions are equal iff it is."""
    return F.expr("struct(" + ", ".join(f"{_comparable(c)} AS {c}" for c in COMPARED) + ")")


def row_changed(old: str, new: str) -> Column:
    """Whether `new.*` must replace `old.*`: other content, or `old` is deleted."""
    same = " AND ".join(
        f"{_comparable(c, old + '.')} <=> {_comparable(c, new + '.')}" for c in COMPARED
    )
    return F.expr(f"NOT ({same}) OR coalesce({old}.deleted, 0) <> 0")
