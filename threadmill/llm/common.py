"""What several operators need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.sinks.shared import scratch_path, settled

__all__ = ["WORD", "free_names", "n_words", "partitions", "running_totals", "scratch_path", "settled", "small_side"]

# A word is a run of anything but the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

# A table is broadcast only if its rows, at so many bytes each, are known to fit.
BROADCAST_BYTES = 32 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_names(docs: DataFrame, n: int) -> list[str]:
    """Names for columns beside those of `docs`."""
    start = "_m"
    while any(c.lower().startswith(start) for c in docs.columns):
        start += "m"
    return [f"{start}{i}" for i in range(n)]


def small_side(written: DataFrame, bytes_per_row: int = 64) -> DataFrame:
    """`written`, a table on disk, marked for a broadcast join if it is small.

    Beyond the bound Spark joins by sorting, and splits skewed partitions; the
    result is the same."""
    few = BROADCAST_BYTES // bytes_per_row
    return F.broadcast(written) if written.count() <= few else written.hint("merge")


def running_totals(
    rows: DataFrame, order: Sequence[Column], value: str, within: Sequence[Column] = ()
) -> DataFrame:
    """`rows` with `offset`, the sum of `value` over the rows before, and
    `rank`, their number, in the given order.

    Rows are dealt into ranges of the order and written; each range is summed
    on its own, and ranges start at the sum of those before.  One task sees one
    range or one row per range, however many rows compare equal: an arbitrary
    number per row, fixed once the ranges are written, splits these too.

    With `within`, rows that are equal in `order` follow by these columns, stay in
    one range, and the ranges are cut without looking at them: for columns too
    long to be sampled.
    """
    spark = rows.sparkSession
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranges = tied.repartitionByRange(partitions(spark), *order, *([] if within else [F.col("_tie")]))
    dealt = settled(ranges.withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    starts = settled(
        totals.select(
            F.col("_range"),
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        )
    )
    inside = Window.partitionBy("_range").orderBy(*order, *within, "_tie")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumns(
        {"_upto": F.sum(value).over(so_far), "_number": F.row_number().over(inside)}
    ).join(small_side(starts), "_range")
    return placed.select(
        *rows.columns,
        (F.col("_before") + F.col("_upto") - F.col(value)).alias("offset"),
        (F.col("_rows_before") + F.col("_number") - 1).alias("rank"),
    )
