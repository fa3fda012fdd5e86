"""Chat identifiers, topics and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadmill.functions.text import strip
from threadmill.schema import NO_TOPIC

# Path of a web address without query, fragment and parameters of its last
# segment.  A pattern never fails on malformed input, unlike parse_url.
_PATH = r"\Ahttps?://[^/?#]*([^?#]*)"
_FIRST = r"\A/*([^/]+)"
_SECOND = r"\A/*[^/]+/+([^/]+)"


def _is_link(identifier: Column) -> Column:
    return identifier.startswith("http://") | identifier.startswith("https://")


def _path(identifier: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(identifier, _PATH, 1), r";[^/]*\z", "")


def _name(identifier: Column) -> Column:
    slug = F.regexp_extract(_path(identifier), _FIRST, 1)
    return F.when(_is_link(identifier) & (slug != ""), slug).otherwise(identifier)


def _topic(identifier: Column) -> Column:
    segment = F.regexp_extract(_path(identifier), _SECOND, 1)
    whole_number = segment.rlike(r"\A[+-]?[0-9]+\z")
    return F.when(_is_link(identifier) & whole_number, segment.try_cast("bigint"))


def chat_name(raw: Column) -> Column:
    """Chat part of a plain name or of a link `http(s)://host/<chat>[/<topic>]`."""
    return _name(strip(raw))


def chat_topic(raw: Column, explicit: Column | None = None) -> Column:
    """Topic part of a link, NULL if none; an explicit topic wins.

    Digits grouped by '_' are not read as a number.
    """
    found = _topic(strip(raw))
    return found if explicit is None else F.coalesce(explicit, found)


def _without_at(raw: Column) -> Column:
    return F.regexp_replace(strip(raw), r"\A@", "")


def export_chat_name(raw: Column) -> Column:
    """Like :func:`chat_name`, after removing one leading '@'."""
    return _name(_without_at(raw))


def export_chat_topic(raw: Column) -> Column:
    """Like :func:`chat_topic`, after removing one leading '@'."""
    return _topic(_without_at(raw))


def topic_or_none(topic_id: Column) -> Column:
    """NULL topic becomes -1; 0 is a topic."""
    return F.coalesce(topic_id, F.lit(NO_TOPIC).cast("bigint"))


def safe_name(name: Column) -> Column:
    """A name fit for a file: runs of other characters become one '_'."""
    plain = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    trimmed = F.trim(F.regexp_replace(plain, r"_+", "_"), F.lit("._-"))
    return F.when(trimmed == "", F.lit("export")).otherwise(trimmed)


def merged_name(chat: Column) -> Column:
    """The shorter variant, without collapsing and trimming, for merged tables."""
    return F.regexp_replace(chat, r"[^A-Za-z0-9._-]+", "_")


def export_base_name(chat: Column, topic_id: Column) -> Column:
    """Base of an export's file name: the chat, and its topic if there is one."""
    topic = topic_or_none(topic_id)
    suffix = F.when(topic != NO_TOPIC, F.concat(F.lit("_"), topic.cast("string")))
    return F.concat(safe_name(chat), F.coalesce(suffix, F.lit("")))
