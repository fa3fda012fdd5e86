"""Upserts: one increment onto a table, and many sources into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.identifiers import topic_or_none
from threadmill.operators.filters import flag, row_changed
from threadmill.operators.hotkeys import HOT_ROWS
from threadmill.operators.versions import crowded_keys, fold_versions
from threadmill.schema import KEY, MESSAGES

_COLUMNS = [f.name for f in MESSAGES]
_REST = [c for c in _COLUMNS if c not in KEY]


def _keyed(messages: DataFrame) -> DataFrame:
    return messages.withColumn("topic_id", topic_or_none(F.col("topic_id")))


def new_rows(staged: DataFrame, current: DataFrame) -> DataFrame:
    """Staged rows whose key the table lacks."""
    return _keyed(staged).join(_keyed(current).select(*KEY), list(KEY), "left_anti")


def known_rows(staged: DataFrame, current: DataFrame) -> DataFrame:
    """Staged rows whose key the table has."""
    return _keyed(staged).join(_keyed(current).select(*KEY), list(KEY), "left_semi")


def _folded(staged: DataFrame, order: Sequence[str], hot_rows: int) -> DataFrame:
    """The increment folded on its own: per key its surviving version as `new`, and
    whether others took effect before (`more`)."""
    extra = [c for c in order if c not in _COLUMNS]
    rows = (
        _keyed(staged)
        .withColumns({"deleted": F.lit(0), "source_order": F.lit(1)})
        .select(*_COLUMNS, "source_order", *extra)
    )
    folded = fold_versions(rows, ("source_order", *order), crowded_keys(rows, hot_rows))
    return folded.select(*KEY, F.struct(*_REST).alias("new"), (F.col("effects") > 1).alias("more"))


def _upserted(pairs: DataFrame) -> DataFrame:
    """Rows of (key, `old`, `new`, `more`), either side of which may be missing, as
    message columns and `change_type`.

    The surviving version of the increment wins unless it alone took effect there
    and says what the table says already.
    """
    kind = (
        F.when(F.col("new").isNull(), "unchanged")
        .when(F.col("old").isNull(), "insert")
        .when(flag(F.col("old.deleted")), "revive")
        .when(F.col("more") | row_changed("old", "new"), "update")
        .otherwise("unchanged")
    )
    kept = F.col("change_type") == "unchanged"

    def value(name: str):
        if name in KEY:
            return F.col(name)
        if name == "id":
            return F.when(F.col("old").isNotNull(), F.col("old.id")).otherwise(F.col("new.id")).alias(name)
        return F.when(kept, F.col("old." + name)).otherwise(F.col("new." + name)).alias(name)

    return pairs.withColumn("change_type", kind).select(*map(value, _COLUMNS), "change_type")


def _as_old(current: DataFrame) -> DataFrame:
    return _keyed(current).select(*KEY, F.struct(*_REST).alias("old"))


def upsert_changes(
    current: DataFrame,
    staged: DataFrame,
    order: Sequence[str] = ("id",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The state of every staged key after the upsert, with `change_type`:
    insert, update, revive (a deleted row seen again) or unchanged.

    `current` has one row per key.  `staged` may hold several versions of a
    key; they apply in `order`.  Only rows of `current` with a staged key are
    shuffled when the staged keys are few enough for Spark to broadcast, else the
    table is shuffled once.  Keys with very many staged versions are split.
    """
    touched = _as_old(current).join(_keyed(staged).select(*KEY).distinct(), list(KEY), "left_semi")
    return _upserted(_folded(staged, order, hot_rows).join(touched, list(KEY), "left"))


def upsert_snapshot(
    current: DataFrame,
    staged: DataFrame,
    order: Sequence[str] = ("id",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The whole table after the upsert.

    Rows of the table are shuffled once, or not at all when the folded increment is
    small enough to broadcast; finding the new keys reads the key columns again.
    """
    folded = _folded(staged, order, hot_rows)
    table = _as_old(current).join(folded, list(KEY), "left")
    known = _keyed(current).select(*KEY).join(folded.select(*KEY), list(KEY), "left_semi")
    new = folded.join(known, list(KEY), "left_anti")
    rows = table.unionByName(new, allowMissingColumns=True)
    return _upserted(rows).select(*_COLUMNS)


def apply_log(current: DataFrame, log: DataFrame) -> DataFrame:
    """The table with the rows of `log`, one per key, put in place of its own."""
    rest = current.select(*_COLUMNS).join(log.select(*KEY), list(KEY), "left_anti")
    return rest.select(*_COLUMNS).unionByName(log.select(*_COLUMNS))


def change_summary(changes: DataFrame, marked_deleted: DataFrame | None = None) -> DataFrame:
    """One row of exact counts by kind of change, and whether exports must be rebuilt."""
    kinds = changes.select("change_type")
    if marked_deleted is not None:
        kinds = kinds.unionByName(marked_deleted.select(F.lit("delete").alias("change_type")))

    def of(kind: str):
        return F.count_if(F.col("change_type") == kind)

    counts = kinds.agg(
        of("insert").alias("inserted"),
        of("update").alias("updated"),
        of("revive").alias("revived"),
        of("delete").alias("deleted"),
        of("unchanged").alias("unchanged"),
    )
    changed = F.col("inserted") + F.col("updated") + F.col("revived") + F.col("deleted")
    return counts.withColumn("export_needed", changed > 0)


def _merged(sources: DataFrame, hot_rows: int) -> DataFrame:
    rows = sources.select(*_COLUMNS, "source_order")
    return fold_versions(rows, hot=crowded_keys(rows, hot_rows))


def merge_sources(sources: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Merge the rows of all sources (tagged `source_order`) into one table.

    An existing target is source 0.  A first version keeps its `deleted`; a
    later one that takes effect clears it, so a second copy revives a message
    another source has marked as deleted.
    """
    return _merged(sources, hot_rows).select(*_COLUMNS)


def merge_counters(sources: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows processed, inserted, updated and skipped by :func:`merge_sources`."""
    folded = _merged(sources, hot_rows)
    total, effects = F.coalesce(F.sum("versions"), F.lit(0)), F.coalesce(F.sum("effects"), F.lit(0))
    keys = F.count(F.lit(1))
    return folded.agg(
        total.alias("processed"),
        keys.alias("inserted"),
        (effects - keys).alias("updated"),
        (total - effects).alias("skipped"),
    )
