"""Rate evaluation over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from threadmill.operators.rates import LIMIT, WINDOW_SECONDS, admit
from threadmill.sinks.shared import settled


def _evaluated(events: DataFrame, state: DataFrame, key: str, time: str, tie: str, limit: int, span: int) -> DataFrame:
    """(key, tie, admitted) of the events, and (key, recent) of every key afterwards.

    Spark sorts the events of a key after its state; they pass through in Arrow
    batches, and a task holds one batch and `limit` times."""
    fields = events.schema
    output = T.StructType(
        [
            fields[key],
            fields[tie],
            T.StructField("admitted", T.BooleanType()),
            T.StructField("recent", T.ArrayType(T.LongType())),
        ]
    )
    timed = events.where(F.col(time).isNotNull()).select(
        key, tie, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.lit(None).cast("array<long>").alias("recent")
    )
    earlier = state.select(key, F.lit(None).cast(fields[tie].dataType).alias(tie), F.lit(None).cast("long").alias("_t"), "recent")
    rows = (
        earlier.unionByName(timed)
        .withColumn("_same", F.to_json(F.struct(key)))
        .repartition(key)
        .sortWithinPartitions(key, F.col("_t").asc_nulls_first(), tie)
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, value, recent = None, None, np.empty(0, dtype=np.int64)
        types: dict[str, pa.DataType] = {}

        def ended(finished: list) -> pa.RecordBatch:
            n = len(finished)
            columns = [
                pa.array([v for v, _ in finished], types[key]),
                pa.nulls(n, types[tie]),
                pa.nulls(n, pa.bool_()),
                pa.array([r.tolist() for _, r in finished], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, output.names)

        for batch in batches:
            types = {c: batch.column(c).type for c in (key, tie)}
            is_event = batch.column("_t").is_valid().to_numpy(zero_copy_only=False)
            times = batch.column("_t").fill_null(0).to_numpy()
            same = batch.column("_same").to_numpy(zero_copy_only=False)
            flags, finished = np.zeros(len(times), dtype=bool), []
            edges = [0, *(np.flatnonzero(same[1:] != same[:-1]) + 1), len(times)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi > lo and same[lo] != current:
                    if current is not None:
                        finished.append((value, recent))
                    current, value, recent = same[lo], batch.column(key)[lo].as_py(), np.empty(0, dtype=np.int64)
                if hi > lo and not is_event[lo]:
                    recent = np.array(batch.column("recent")[lo].as_py(), dtype=np.int64)
                    lo += 1
                flags[lo:hi], recent = admit(times[lo:hi], recent, limit, span)
            out = [batch.column(key), batch.column(tie), pa.array(flags), pa.nulls(len(batch), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, output.names).filter(pa.array(is_event))
            if finished:
                yield ended(finished)
        if current is not None:
            yield ended([(value, recent)])

    return rows.mapInArrow(walk, output)


def stream_rate_admitted(
    events: DataFrame,
    key: str,
    time: str,
    tie: str,
    folder: str,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
) -> StreamingQuery:
    """Evaluate a stream of events; :func:`admitted_events` reads the result.

    Micro-batches apply in the order they arrive, and the events of one by time, then
    `tie`.  Between micro-batches a table in `folder` holds each key's last admitted
    times, at most `limit`; a micro-batch writes the next one, from that of the
    batch before, so a repeated batch writes the same again.  Times are kept for
    ever: dropping old ones would let in events that come late.  Events without a
    time are neither admitted nor rejected (`admitted` is NULL) and change nothing.
    """
    spark = events.sparkSession
    span = window_seconds * 1_000_000
    states = T.StructType([events.schema[key], T.StructField("recent", T.ArrayType(T.LongType()))])

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        if batch_id:
            state = spark.read.schema(states).parquet(f"{folder}/state/batch_id={batch_id - 1}")
        else:
            state = spark.createDataFrame([], states)
        done = settled(_evaluated(batch, state, key, time, tie, limit, span))
        untimed = batch.where(F.col(time).isNull()).select(key, tie, F.lit(None).cast("boolean").alias("admitted"))
        flagged = done.where("recent IS NULL").drop("recent").unionByName(untimed)
        flagged.write.mode("overwrite").parquet(f"{folder}/admitted/batch_id={batch_id}")
        left = done.where("recent IS NOT NULL").select(key, "recent")
        left.write.mode("overwrite").parquet(f"{folder}/state/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(evaluate)
        .option("checkpointLocation", f"{folder}/offsets")
        .trigger(availableNow=True)
        .start()
    )


def admitted_events(spark: SparkSession, folder: str) -> DataFrame:
    """(key, tie, admitted) of all events a stream has evaluated into `folder`."""
    return spark.read.parquet(f"{folder}/admitted").drop("batch_id")
