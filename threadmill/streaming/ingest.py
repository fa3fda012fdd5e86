"""Incremental ingest as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadmill.operators.filters import content, flag, since
from threadmill.operators.versions import effects
from threadmill.schema import KEY, LANDED, MESSAGES, SCOPE
from threadmill.sinks.manifest import Conflict
from threadmill.sinks.shared import settled
from threadmill.sinks.store import FOLD_AFTER, MessageStore, version
from threadmill.sources.raw import canonical_scope, flatten_raw

# Later scans and later edits apply last; `version` only makes the order total.
_ORDER = ("updated_at", "edit_date", "version")


def landed_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed JSON lines as a stream, a bounded number of files at a time."""
    reader = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def reached(staged: DataFrame) -> DataFrame:
    """Checkpoints after the rows of an increment."""
    return staged.groupBy(*SCOPE).agg(
        F.max("message_id").alias("last_message_id"), F.max("updated_at").alias("last_run_ts")
    )


def ordered_changes(state: DataFrame, staged: DataFrame) -> DataFrame:
    """The rows of a store's `state` after the versions in `staged`, with
    `change_type`, if the versions of a key apply in the order of their scans,
    whenever they come.

    A row reads as it does since the first scan of its `run`.  A version from
    before `before` changes nothing: what it would start has ended.  One between
    begins the run earlier if it reads the same; one inside the run that reads
    differently cuts it, and what is left begins with the next scan.  So these scans
    are all that is kept of a key, and all others are forgotten.
    """
    place = F.struct("updated_at", "edit_date", "version")
    keys = list(KEY)
    facts = F.struct(
        content().alias("content"), "updated_at", "date", "chat_id", flag(F.col("deleted")).alias("deleted"), "id"
    )
    columns = [*MESSAGES.names, "version"]
    known = state.join(staged.select(*KEY).distinct(), keys, "left_semi").withColumns(
        {"version": version(), "_old": facts}
    )
    scans = known.withColumn("_scan", F.explode("run"))
    own = scans.withColumns({c: F.col(f"_scan.{c}") for c in ("updated_at", "date", "chat_id")})
    limits = known.select(*KEY, "before")
    late = (
        staged.select(*MESSAGES.names)
        .withColumn("version", version())
        .join(limits, keys, "left")
        .where(F.col("before").isNull() | (place > F.col("before")))
    )
    versions = own.select(*columns, "_old", "before").unionByName(
        late.select(*columns, "before"), allowMissingColumns=True
    )
    numbered = effects(versions, _ORDER)
    last = F.max(F.when(F.col("takes_effect"), F.col("version_no"))).over(Window.partitionBy(*KEY))
    number = F.col("version_no")
    fields = [c for c in MESSAGES.names if c not in (*KEY, "id", "deleted")]
    folded = (
        numbered.withColumn("_last", last)
        .groupBy(*KEY)
        .agg(
            F.max_by(F.struct(*fields), F.when(number == F.col("_last"), F.lit(1))).alias("row"),
            F.sort_array(
                F.collect_set(F.when(number >= F.col("_last"), F.struct("updated_at", "date", "chat_id")))
            ).alias("run"),
            F.max(F.when(number < F.col("_last"), place)).alias("_ended"),
            F.max("before").alias("_before"),
            F.first("_old", ignorenulls=True).alias("_old"),
            F.max("_last").alias("_last"),
            F.max(F.when(number == 1, F.coalesce("deleted", F.lit(0)))).alias("_deleted"),
        )
    )
    now = F.struct(content().alias("content"), "updated_at", "date", "chat_id", flag(F.col("deleted")).alias("deleted"), "id")
    rows = folded.select(
        *KEY,
        F.col("_old.id").alias("id"),
        *(F.col(f"row.{c}").alias(c) for c in fields),
        F.when(F.col("_last") == 1, F.col("_deleted")).otherwise(F.lit(0)).alias("deleted"),
        "run",
        F.coalesce("_ended", "_before").alias("before"),
        "_old",
    )
    kind = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_old.deleted") & (F.col("deleted") == 0), "revive")
        .when(F.col("_old") != now, "update")
        .otherwise("unchanged")
    )
    return rows.select(*MESSAGES.names, "run", "before", kind.alias("change_type"))


def stream_upsert(
    landed: DataFrame,
    store: MessageStore,
    checkpoint: str,
    cutoff: object | None = None,
    writer: str = "stream",
    fold_after: int = FOLD_AFTER,
) -> StreamingQuery:
    """Upsert every micro-batch of landed records into the store.

    Records apply in the order they were scanned, whatever files and micro-batches
    they are in: a scan that arrives late goes to its place, for which the store keeps
    a little of every key.  The table ends the same for any order of the files and any
    number of them per trigger.  A micro-batch reads the partitions its keys lie in;
    the log is folded into the base after `fold_after` batches, so a batch costs the
    same however many came before.

    `cutoff` drops older records with a plain filter: a watermark would also
    drop records of files that merely arrive out of order.  Exact copies within
    a micro-batch collapse before the upsert, so a message landed many times
    over is no burden.  A micro-batch of `writer` that comes again changes nothing, and
    one that meets a batch of another writer is computed anew.

    The rows of each batch are observed under the name `ingest`, for a
    StreamingQueryListener; what the upsert made of them is in the store's counters.
    """
    rows = canonical_scope(flatten_raw(landed, F.col("scanned_at")))
    if cutoff is not None:
        rows = since(rows, cutoff)
    rows = rows.observe("ingest", F.count(F.lit(1)).alias("rows"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        if store.applied(writer, batch_id):
            return
        staged = settled(
            batch.distinct().withColumns({"id": F.lit(None).cast("bigint"), "deleted": F.lit(0)})
        )
        near = store.places(staged)
        while True:
            seen = store.version()
            try:
                changes = settled(ordered_changes(store.state(near=near), staged))
                store.commit(writer, batch_id, changes, reached(staged), seen)
                break
            except Conflict:
                continue
        if store.counters().count() >= fold_after:
            store.fold()

    return (
        rows.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
