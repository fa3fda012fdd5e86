"""CSV and JSONL exports.

Both are sorted by date over all part files: the files in name order are the
export.  A consumer that needs a single file concatenates them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.times import iso_text
from threadmill.operators.dedupe import (
    candidates,
    chronological,
    cleaned,
    dedupe_csv,
    dedupe_jsonl,
)
from threadmill.operators.filters import flag, in_chat
from threadmill.schema import EXPORT_COLUMNS, JSONL_FIELDS

_DATES = ("date", "edit_date", "updated_at")
# Marks a file as UTF-8 for spreadsheet programs.
_BYTE_ORDER_MARK = "\ufeff"
_RECORD_END = "\r\n"


def csv_rows(messages: DataFrame, dedupe: str | None = None) -> DataFrame:
    """What the CSV export holds, in order: all messages, or the first of each
    group of copies if a dedupe mode is given."""
    rows = messages if dedupe is None else dedupe_csv(messages, dedupe)
    return rows.orderBy(*chronological()).select(
        *(iso_text(F.col(c)).alias(c) if c in _DATES else F.col(c) for c in EXPORT_COLUMNS)
    )


def _field(value: Column) -> Column:
    """A value as it stands in a record: quoted if it holds a comma, a quote or a line end."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text)


def _as_csv(rows: DataFrame, path: str, mode: str, mark: bool) -> None:
    header = (_BYTE_ORDER_MARK if mark else "") + ",".join(rows.columns)
    line = F.concat_ws(",", *(_field(F.col(c)) for c in rows.columns))
    # Numbers of rows start anew, from a multiple of 2**33, in each file.
    opens = F.monotonically_increasing_id() % (1 << 33) == 0
    lines = rows.select(F.when(opens, F.concat(F.lit(header + _RECORD_END), line)).otherwise(line).alias("value"))
    if rows.isEmpty():
        lines = rows.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value"))
    lines.write.mode(mode).option("lineSep", _RECORD_END).text(path)


def write_csv(messages: DataFrame, path: str, dedupe: str | None = None) -> None:
    """Spreadsheet-friendly CSV: byte order mark and header in every file, also
    if there are no messages.

    Records end with a carriage return and a line feed; texts keep the line ends
    they have.  Spark's own CSV writer would turn every line feed inside a text
    into the end of a record, so records are written as text; the part files are
    named `.txt`.
    """
    _as_csv(csv_rows(messages, dedupe), path, "overwrite", mark=True)


def append_csv(rows: DataFrame, path: str) -> None:
    """Add rows as further files, with headers but without byte order marks."""
    _as_csv(csv_rows(rows), path, "append", mark=False)


def jsonl_rows(
    messages: DataFrame,
    chat_identifier: str | None = None,
    topic_id: int | None = None,
    include_deleted: bool = False,
    include_service: bool = False,
    min_chars: int = 0,
    skip_hashtag_only: bool = False,
    dedupe: str | None = None,
) -> DataFrame:
    """What the JSONL export holds, in order, as columns."""
    rows = candidates(in_chat(messages, chat_identifier, topic_id), include_deleted, include_service)
    if dedupe is None:
        # Sorting first: finding the ranges reads its input once more, and
        # would clean every text twice.
        rows = cleaned(rows.orderBy(*chronological()), min_chars, skip_hashtag_only)
    else:
        rows = dedupe_jsonl(cleaned(rows, min_chars, skip_hashtag_only), dedupe)
        rows = rows.orderBy(*chronological())
    fields = {
        "chat": F.col("chat_identifier"),
        "date": iso_text(F.col("date")),
        "edit_date": iso_text(F.col("edit_date")),
        "is_service": flag(F.col("is_service")),
        "deleted": flag(F.col("deleted")),
    }
    return rows.select(
        *(fields.get(name, F.col(name)).alias(name) for name in JSONL_FIELDS)
    )


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object per line, NULLs kept, nothing but what JSON demands escaped."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    rows.select(line.alias("value")).write.mode("overwrite").text(path)
