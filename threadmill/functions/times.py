"""Dates: order keys, rendering, stamps in file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def second_of(date: Column) -> Column:
    """Order key of a typed date: whole seconds."""
    return F.date_trunc("second", date)


def utc_order_key(iso_text: Column) -> Column:
    """Order key of an ISO text: moved to UTC, whole seconds, NULL if unreadable."""
    full_date = iso_text.rlike(r"\A\d{4}-\d{2}-\d{2}([T ]|\z)")
    return F.when(full_date, F.date_trunc("second", F.try_to_timestamp(iso_text)))


def iso_text(date: Column) -> Column:
    """ISO 8601 with offset; a fraction only where there is one."""
    fraction = F.date_format(date, ".SSSSSS")
    return F.concat(
        F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == ".000000", F.lit("")).otherwise(fraction),
        F.lit("+00:00"),
    )


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def named_stamp(name: Column) -> Column:
    """The text `YYYYmmdd_HHMMSS` after an underscore in a file name, '' if none."""
    return F.regexp_extract(name, r"_(\d{8}_\d{6})", 1)


def artifact_time(name: Column, modified: Column) -> Column:
    """Date of a stored file: the stamp in its name, else its modification time.

    A stamp that is no date gives NULL: such a file is never judged by age.
    """
    stamp = named_stamp(name)
    return F.when(stamp == "", modified).otherwise(
        F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))
    )


def moment(df: DataFrame, column: str, value: object) -> Column:
    """`value` (text, datetime or Column) in the type of `column`.

    Same type on both sides keeps a comparison free of casts on the column, so
    that it reaches the file scan.
    """
    literal = value if isinstance(value, Column) else F.lit(str(value))
    return literal.cast(df.schema[column].dataType)
