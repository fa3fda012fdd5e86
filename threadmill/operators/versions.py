"""Versions of a message: the fold behind upserts and merges.

Per key, versions r1..rn come in a given order and each is upserted onto the
result of the ones before.  A version *takes effect* iff it is the first, or
its content differs from the version right before it, or it is the second and
the first was deleted.  Looking at the version right before is enough: one
without effect equals the state it left alone.  The last version that takes
effect wins; it keeps the first one's id, and is not deleted unless it is the
first itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.identifiers import topic_or_none
from threadmill.operators.arrival import tie
from threadmill.operators.filters import content, flag
from threadmill.operators.hotkeys import HOT_ROWS, hot_keys, split_hot
from threadmill.schema import KEY
from threadmill.sinks.shared import settled

ORDER = ("source_order", "id")


def _state() -> Column:
    return F.struct(content().alias("content"), flag(F.col("deleted")).alias("deleted"))


def _in_order(versions: DataFrame, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Number versions and look back, one window per key; equal ones by content."""
    by_key = Window.partitionBy(*keys).orderBy(*order, tie(versions.columns))
    return versions.withColumns(
        {
            "version_no": F.row_number().over(by_key).cast("bigint"),
            "previous": F.lag(_state()).over(by_key),
        }
    )


def _in_ranges(
    versions: DataFrame, order: Sequence[str], keys: Sequence[str], ranges: int | None
) -> DataFrame:
    """The same for hot keys, as a prefix scan over ranges of (key, order).

    Rows are dealt to ranges that Spark cuts by what it sampled, so a giant key is
    spread over many, whatever orders it.  The windows look within a range; each
    range then learns from the last rows of those before it how many versions of
    its first key came before, and what the last of them was.  Which range a row is
    in is written down: a task that runs again could not change it.

    Only rows equal in their order and all content stay together.
    """
    count = ranges or int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = versions.withColumn("_tie", tie(versions.columns))
    dealt = settled(
        tied.repartitionByRange(count, *keys, *order, "_tie").withColumn("_range", F.spark_partition_id())
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy(*order, "_tie")
    over_ranges = Window.partitionBy(*keys).orderBy("_range")
    rows = dealt.withColumns(
        {
            "_no": F.row_number().over(in_range).cast("bigint"),
            "_before": F.lag(_state()).over(in_range),
            "_more": F.lead(F.lit(True)).over(in_range),
        }
    )
    # One row per key and range.
    tails = rows.where(F.col("_more").isNull()).select(
        *keys,
        "_range",
        F.sum("_no").over(over_ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_offset"),
        F.lag(_state()).over(over_ranges).alias("_carried"),
    )
    return (
        rows.join(tails, [*keys, "_range"])
        .withColumn("version_no", F.col("_no") + F.coalesce("_offset", F.lit(0)))
        .withColumn("previous", F.when(F.col("_no") == 1, F.col("_carried")).otherwise(F.col("_before")))
        .drop("_range", "_tie", "_no", "_before", "_more", "_offset", "_carried")
    )


def _takes_effect() -> Column:
    first = F.col("version_no") == 1
    revives = (F.col("version_no") == 2) & F.col("previous.deleted")
    return first | revives | ~F.col("previous.content").eqNullSafe(content())


def _branches(
    versions: DataFrame,
    order: Sequence[str],
    hot: DataFrame | None,
    ranges: int | None = None,
    keys: Sequence[str] = KEY,
) -> list[DataFrame]:
    versions = versions.withColumn("topic_id", topic_or_none(F.col("topic_id")))
    if hot is None:
        parts = [_in_order(versions, order, keys)]
    else:
        ordinary, crowded = split_hot(versions, keys, hot)
        parts = [_in_order(ordinary, order, keys), _in_ranges(crowded, order, keys, ranges)]
    return [p.withColumn("takes_effect", _takes_effect()) for p in parts]


def effects(versions: DataFrame, order: Sequence[str] = ORDER, keys: Sequence[str] = KEY) -> DataFrame:
    """Every version of ordinary keys with `version_no` and `takes_effect`."""
    return _branches(versions, order, None, keys=keys)[0].drop("previous")


def crowded_keys(
    versions: DataFrame, hot_rows: int = HOT_ROWS, keys: Sequence[str] = KEY
) -> DataFrame | None:
    """Keys with very many versions, if any; reads narrow columns only, at once."""
    normal = versions.withColumn("topic_id", topic_or_none(F.col("topic_id")))
    telling = (*ORDER, "date", "edit_date", "updated_at", "sender_id")
    return hot_keys(normal, keys, [c for c in telling if c in versions.columns], hot_rows)


def version_history(
    versions: DataFrame, hot: DataFrame | None = None, ranges: int | None = None
) -> DataFrame:
    """Every version with its number and whether it takes effect.

    `versions` has the message columns and `source_order`; `hot` and `ranges` are
    as in :func:`fold_versions`.
    """
    hot = crowded_keys(versions) if hot is None else hot
    return reduce(DataFrame.unionByName, _branches(versions, ORDER, hot, ranges)).drop("previous")


def fold_versions(
    versions: DataFrame,
    order: Sequence[str] = ORDER,
    hot: DataFrame | None = None,
    ranges: int | None = None,
    keys: Sequence[str] = KEY,
) -> DataFrame:
    """One row per key: the surviving version, plus `first_source`,
    `was_deleted` (the first version's flag), `versions` and `effects` (counts).

    Ordinary keys need one shuffle: the aggregation reuses the window's
    partitioning and order.  Hot keys, those in `hot` from :func:`crowded_keys`,
    are cut into `ranges` (by default as many as a shuffle has partitions) and
    aggregated partially before their last shuffle; without `hot` all are ordinary.
    """
    columns = [c for c in versions.columns if c not in (*keys, "source_order")]
    winner = F.struct(*(c for c in columns if c not in ("id", "deleted")), "version_no")

    def fold(part: DataFrame) -> DataFrame:
        effective = F.when(F.col("takes_effect"), F.col("version_no"))
        origin = F.struct("id", "deleted", "source_order")
        return (
            part.groupBy(*keys)
            .agg(
                F.max_by(winner, effective).alias("last"),
                F.min_by(origin, "version_no").alias("first"),
                F.count(F.lit(1)).alias("versions"),
                F.count_if("takes_effect").alias("effects"),
            )
            .select(
                *keys,
                F.col("first.id").alias("id"),
                *(F.col("last." + c).alias(c) for c in columns if c not in ("id", "deleted")),
                F.when(F.col("last.version_no") == 1, F.col("first.deleted"))
                .otherwise(F.lit(0))
                .alias("deleted"),
                F.col("first.source_order").alias("first_source"),
                flag(F.col("first.deleted")).alias("was_deleted"),
                "versions",
                "effects",
            )
        )

    return reduce(DataFrame.unionByName, map(fold, _branches(versions, order, hot, ranges, keys)))
