"""Per-key rate evaluation over event logs.

Events have a key, a time and an id that settles ties.  An event is *admitted*
iff fewer than `limit` admitted events of its key lie in (t - window, t].
Rejected events do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ----------------------------------------------------------------
LIMIT = 100
WINDOW_SECONDS = 60
EXEMPT_PATHS = ("/health", "/health/")
# ---------------------------------------------------------------------------------

# Windows per block in offered_load: one in BLOCK_WINDOWS of a key's time span is
# read twice, and no task sees more of a key than this many windows.
BLOCK_WINDOWS = 8


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def not_exempt(events: DataFrame, path: str = "path") -> DataFrame:
    """Requests the rate rule applies to."""
    return events.where(~F.coalesce(F.col(path).isin(*EXEMPT_PATHS), F.lit(False)))


def offered_load(
    events: DataFrame,
    key: str,
    time: str,
    window_seconds: int = WINDOW_SECONDS,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Adds `offered`: events of the key in (t - window, t], at the same instant too.

    A key's time is cut into blocks, so a busy key is spread over many tasks.
    The last window of a block also goes to the next one, where it is counted
    but not returned.  Events without a time count nowhere; their `offered` is NULL.
    """
    span = window_seconds * 1_000_000
    block = F.floor(F.col("_t") / (span * block_windows))
    last_window = F.floor((F.col("_t") + span) / (span * block_windows)) > block
    homes = F.when(last_window, F.array(block, block + 1)).otherwise(F.array(block))
    placed = (
        events.where(F.col(time).isNotNull())
        .withColumn("_t", _micros(F.col(time)))
        .withColumn("_block", F.explode(homes))
    )
    trailing = Window.partitionBy(key, "_block").orderBy("_t").rangeBetween(-(span - 1), 0)
    counted = placed.withColumn("offered", F.count(F.lit(1)).over(trailing))
    known = counted.where(F.col("_block") == block).drop("_t", "_block")
    untimed = events.where(F.col(time).isNull())
    return known.unionByName(untimed.withColumn("offered", F.lit(None).cast("bigint")))


def admit(times: np.ndarray, recent: np.ndarray, limit: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Admission flags for sorted `times` of one key, and its last `limit`
    admitted times, given those from before.

    Admits up to `limit` events at once while the limit does not bind, and
    jumps over a run of rejected events in one step.
    """
    flags = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        chunk = times[i : i + limit]
        # The k-th event from here is blocked by the admitted one `limit` back.
        free = limit - len(recent)
        bound = np.full(len(chunk), False)
        if len(chunk) > free:
            blockers = recent[: len(chunk) - free]
            bound[free:] = chunk[free:] - blockers < span
        n = int(np.argmax(bound)) if bound.any() else len(chunk)
        flags[i : i + n] = True
        recent = np.concatenate([recent, chunk[:n]])[-limit:]
        i += n
        if n < len(chunk):
            i += int(np.searchsorted(times[i:], recent[0] + span, side="left"))
    return flags, recent


def rate_admitted(
    events: DataFrame,
    key: str,
    time: str,
    tie: str,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    """Adds `admitted`.

    Time is cut into blocks of one window.  A block is *calm* if it and the one
    before hold at most `limit` events together: all its events are admitted,
    without looking further, and what comes after it depends on nothing before
    it.  So only runs of busy blocks, each with the calm block before it for a
    start, go through the sequential rule: in Arrow batches, with no more state
    than `limit` times, and as many tasks as there are runs.  Only a key that
    is over the limit without a pause stays in one task.  Events without a time
    are neither admitted nor rejected: NULL.
    """
    span = window_seconds * 1_000_000
    timed = events.where(F.col(time).isNotNull()).withColumn("_t", _micros(F.col(time)))
    timed = timed.withColumn("_block", F.floor(F.col("_t") / span))
    counts = timed.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    by_block = Window.partitionBy(key).orderBy("_block")
    before = F.when(F.lag("_block").over(by_block) == F.col("_block") - 1, F.lag("_n").over(by_block))
    # An empty block before this one: nothing earlier reaches into it.
    fresh = before.isNull()
    blocks = (
        counts.select(key, "_block", before.alias("_before"), "_n", fresh.alias("_fresh"))
        .withColumn("_calm", F.col("_n") + F.coalesce("_before", F.lit(0)) <= limit)
        .withColumn("_after_calm", F.coalesce(F.lag("_calm").over(by_block), F.lit(False)))
        .withColumn("_starts", ~F.col("_calm") & (F.col("_fresh") | F.col("_after_calm")))
        .withColumn("_run", F.sum(F.col("_starts").cast("long")).over(by_block))
        .withColumn("_next_starts", F.coalesce(F.lead("_starts").over(by_block), F.lit(False)))
        .withColumn("_next", F.lead("_block").over(by_block))
        .withColumn(
            "_warms", F.col("_calm") & F.col("_next_starts") & (F.col("_next") == F.col("_block") + 1)
        )
        .select(F.col(key).alias("_key"), F.col("_block").alias("_at"), "_calm", "_run", "_warms")
    )
    # Null-safe: events without a key are one key, as in the windows above.
    at = timed[key].eqNullSafe(blocks["_key"]) & (timed["_block"] == blocks["_at"])
    placed = timed.join(blocks, at)
    columns = events.columns
    calm = placed.where("_calm").select(*columns, F.lit(True).alias("admitted"))

    needed = [*columns, "_t", "_run", "_warm"]
    busy = placed.where(~F.col("_calm")).withColumn("_warm", F.lit(False)).select(*needed)
    warm = (
        placed.where("_warms")
        .withColumns({"_run": F.col("_run") + 1, "_warm": F.lit(True)})
        .select(*needed)
    )
    sequence = (
        busy.unionByName(warm)
        .withColumn("_same", F.to_json(F.struct(key, "_run")))
        .repartition(key, "_run")
        .sortWithinPartitions(key, "_run", "_t", tie)
    )
    schema = T.StructType([*events.schema.fields, T.StructField("admitted", T.BooleanType())])

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = None, np.empty(0, dtype=np.int64)
        for batch in batches:
            times = batch.column("_t").to_numpy()
            runs = batch.column("_same").to_numpy(zero_copy_only=False)
            flags = np.zeros(len(times), dtype=bool)
            edges = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1), len(times)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi > lo and runs[lo] != current:
                    current, recent = runs[lo], np.empty(0, dtype=np.int64)
                flags[lo:hi], recent = admit(times[lo:hi], recent, limit, span)
            out = [*(batch.column(c) for c in columns), pa.array(flags)]
            returned = pc.invert(batch.column("_warm"))
            yield pa.RecordBatch.from_arrays(out, [*columns, "admitted"]).filter(returned)

    untimed = events.where(F.col(time).isNull()).withColumn("admitted", F.lit(None).cast("boolean"))
    return calm.unionByName(sequence.mapInArrow(evaluate, schema)).unionByName(untimed)
