"""One query per operator, over tables derived from the given ones.

Every query reads whole tables.  Cutoffs and run times are parameters, so that
a query means the same whenever it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill import schema
from threadmill.functions import identifiers as ids
from threadmill.functions import text as tx
from threadmill.functions import times
from threadmill.operators import (
    aggregate,
    dedupe,
    deletions,
    evolution,
    filters,
    quality,
    rates,
    retention,
    stats,
    upsert,
    versions,
)
from threadmill.plans.aggregate import aggregate_sources, merge_by_chat
from threadmill.plans.sync import SyncRun, sync_store, sync_run
from threadmill.sinks import exports
from threadmill.sinks.shared import scratch_path, settled
from threadmill.sinks.store import MessageStore
from threadmill.sources import files, raw, tables
from threadmill.streaming.ingest import stream_upsert as start_upsert
from threadmill.streaming.rates import admitted_events, stream_rate_admitted
from threadmill.testing import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries.
RUN_TS = "2024-02-01 00:00:00"
LAST_RUN = "2024-01-16 00:00:00"
CUTOFF = "2024-01-10 00:00:00"
EDIT_CUTOFF = "2024-01-20 00:00:00"
RETENTION_NOW = "2024-02-05 12:00:00"
RATE_LIMIT = 3
RATE_WINDOW = 86_400

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def zoneless(df: DataFrame) -> DataFrame:
    """Timestamps as the test tables have them."""
    return df.select(
        *(
            F.col(f.name).cast("timestamp_ntz") if f.dataType == T.TimestampType() else F.col(f.name)
            for f in df.schema
        )
    )


def current_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source, made unique, as the existing table."""
    return dedupe.dedupe_min_id(fx.msgs(spark, sf_dir).where("source_order = 0"))


def staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other sources, as an increment."""
    return fx.msgs(spark, sf_dir).where("source_order <> 0")


def earlier_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run on LAST_RUN left behind; one chat had not been read yet."""
    before = fx.chronological_msgs(spark, sf_dir).where(
        (F.col("date") < F.lit(LAST_RUN).cast("timestamp_ntz")) & (F.col("chat_identifier") != "view")
    )
    topic = ids.topic_or_none(F.col("topic_id")).alias("topic_id")
    return before.groupBy("chat_identifier", topic).agg(
        F.max("message_id").alias("last_message_id"),
        F.lit(LAST_RUN).cast("timestamp_ntz").alias("last_run_ts"),
    )


def scanned_scopes(messages: DataFrame, cutoff: str) -> DataFrame:
    """All chats and topics as scanned back to `cutoff`; one scan was cut short."""
    topic = ids.topic_or_none(F.col("topic_id")).alias("topic_id")
    return messages.select("chat_identifier", topic).distinct().select(
        "chat_identifier",
        "topic_id",
        F.lit(cutoff).cast("timestamp_ntz").alias("cutoff"),
        F.lit(RUN_TS).cast("timestamp_ntz").alias("run_ts"),
        (F.col("chat_identifier") != "error").alias("scan_complete"),
    )


def landed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as JSON text, the way a scan lands them, and parsed again."""
    m = fx.msgs(spark, sf_dir)
    record = F.struct(
        F.col("message_id").alias("id"),
        times.iso_text(F.when(F.col("text").isNotNull(), F.col("date"))).alias("date"),
        times.iso_text(F.col("edit_date")).alias("edit_date"),
        F.col("text").alias("message"),
        F.when(F.col("is_service") == 1, F.struct(F.lit("pinned").alias("kind"))).alias("action"),
        "sender_id",
        F.when(
            F.col("sender_username").isNotNull(), F.struct(F.col("sender_username").alias("username"))
        ).alias("sender"),
        "reply_to_msg_id",
    )
    scope = m.select("chat_id", "chat_identifier", "topic_id", F.to_json(record).alias("r"))
    parsed = filters.computed_once(scope, "r", F.from_json("r", schema.RAW))
    return parsed.select(
        "chat_id", "chat_identifier", "topic_id", "r.*"
    )


# --- scans ------------------------------------------------------------------------


@query
def raw_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zoneless(raw.flatten_raw(landed_records(spark, sf_dir), RUN_TS))


@query
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_project(fx.msgs(spark, sf_dir))


@query
def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fx.msgs(spark, sf_dir).drop("topic_id", "sender_username", "deleted")
    return evolution.tolerant_scan(old)


@query
def multi_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats, prose = fx.msgs(spark, sf_dir), fx.docs_msgs(spark, sf_dir)
    plain = [f.name for f in schema.MESSAGES]
    return tables.multi_source_scan(
        [
            ("chats", "/sources/chats", chats.select(*plain)),
            # An older table, without the columns added later.
            ("old_chats", "/sources/old", chats.select(*plain).drop("topic_id", "deleted")),
            ("prose", "/sources/prose", prose.select(*plain)),
        ]
    )


@query
def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("lang") == "fr", "_Backup.db").when(F.col("lang") == "es", "_archive.db")
    name = F.concat("source", F.coalesce(suffix, F.lit(".db")))
    documents = fx.table(spark, sf_dir, "documents")
    return files.source_catalog(documents.select(name.alias("source_name")))


@query
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.chronological_msgs(spark, sf_dir)
    return raw.incremental_scan(m, earlier_checkpoints(spark, sf_dir), CUTOFF)


@query
def full_history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan without checkpoints and cutoff, into an empty table."""
    found = raw.incremental_scan(fx.chronological_msgs(spark, sf_dir))
    return upsert.upsert_snapshot(found.where("false"), found)


@query
def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.use_utc(spark)
    return files.file_catalog(spark, sf_dir, "*.parquet")


@query
def thread_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.in_thread(fx.msgs(spark, sf_dir), 20)


# --- exports ----------------------------------------------------------------------


@query
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.csv_rows(fx.corpus(spark, sf_dir))


@query
def jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.jsonl_rows(fx.corpus(spark, sf_dir))


@query
def jsonl_export_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.jsonl_rows(
        fx.corpus(spark, sf_dir),
        include_deleted=True,
        include_service=True,
        min_chars=3,
        skip_hashtag_only=True,
        dedupe="text",
    )




def _csv_back(spark: SparkSession, path: str) -> DataFrame:
    back = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', lineSep="\r\n")
    names = (c.lstrip("\ufeff") for c in back.columns)
    return back.toDF(*names).select(*schema.EXPORT_COLUMNS)


@query
def csv_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV files read back, all columns as they stand there."""
    path = scratch_path(spark)
    exports.write_csv(fx.corpus(spark, sf_dir), path)
    return _csv_back(spark, path)


@query
def csv_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first source written and the others appended, read back together."""
    path, corpus = scratch_path(spark), fx.corpus(spark, sf_dir)
    exports.write_csv(corpus.where("source_order = 0"), path)
    exports.append_csv(corpus.where("source_order > 0"), path)
    return _csv_back(spark, path)


@query
def jsonl_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSONL files read back."""
    path = scratch_path(spark)
    exports.write_jsonl(exports.jsonl_rows(fx.corpus(spark, sf_dir)), path)
    fields = T.StructType(
        [
            T.StructField("chat", T.StringType()),
            T.StructField("topic_id", T.LongType()),
            T.StructField("message_id", T.LongType()),
            T.StructField("date", T.StringType()),
            T.StructField("edit_date", T.StringType()),
            T.StructField("sender_id", T.LongType()),
            T.StructField("sender_username", T.StringType()),
            T.StructField("reply_to_msg_id", T.LongType()),
            T.StructField("is_service", T.BooleanType()),
            T.StructField("deleted", T.BooleanType()),
            T.StructField("text", T.StringType()),
        ]
    )
    return spark.read.schema(fields).json(path)


@query
def snapshot_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a base and one increment, read back."""
    fx.use_utc(spark)
    store = MessageStore(spark, scratch_path(spark), buckets=4, ids_per_range=250).create()
    store.write_base(_zoned(current_table(spark, sf_dir)))
    staged = _zoned(staged_rows(spark, sf_dir))
    store.commit("increments", 0, upsert.upsert_changes(store.current(near=staged), staged))
    return zoneless(store.current())


@query
def store_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a base and three increments, folded after the first two."""
    fx.use_utc(spark)
    store = MessageStore(spark, scratch_path(spark), buckets=4, ids_per_range=250).create()
    store.write_base(_zoned(current_table(spark, sf_dir)))
    staged = _zoned(staged_rows(spark, sf_dir))
    low, high = staged.agg(F.min("id"), F.max("id")).first()
    third = (high - low) // 3 + 1
    for batch in range(3):
        some = staged.where(F.expr(f"(id - {low}) div {third} = {batch}"))
        store.commit("increments", batch, upsert.upsert_changes(store.current(near=some), some))
        if batch < 2:
            store.fold()
    return zoneless(store.current())


def _zoned(df: DataFrame) -> DataFrame:
    """The message columns in the types of a stored table."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.MESSAGES))


# --- scalar functions -------------------------------------------------------------


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.corpus(spark, sf_dir)
    return c.select("source_name", "id", tx.normalize_text(F.col("text")).alias("normal"))


@query
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.corpus(spark, sf_dir)
    return c.select("source_name", "id", tx.clean_text(F.col("text")).alias("cleaned"))


def _hashes(spark: SparkSession, sf_dir: str, mode: str, null_sender: str) -> DataFrame:
    c = fx.corpus(spark, sf_dir)
    digest = tx.dedupe_hash(
        tx.normalize_text(F.col("text")),
        F.col("sender_id"),
        F.col("sender_username"),
        F.col("date"),
        mode,
        null_sender,
    )
    return c.select("source_name", "id", digest.alias("dedupe_hash"))


@query
def dedupe_hash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashes(spark, sf_dir, "text", "")


@query
def dedupe_hash_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashes(spark, sf_dir, "text+sender", "")


@query
def dedupe_hash_sender_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashes(spark, sf_dir, "text+sender+day", "None")


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 5
    raw_text = (
        F.when(kind == 0, F.concat(F.lit("  "), "url", F.lit(" \t")))
        .when(kind == 1, F.concat(F.lit("@"), "url"))
        .when(kind == 2, F.concat(F.lit("@name_"), F.col("page_id").cast("string")))
        .otherwise(F.col("url"))
    )
    explicit = F.when(F.col("page_id") % 6 == 0, F.lit(123).cast("bigint"))
    return pages.select("page_id", raw_text.alias("raw"), explicit.alias("explicit"))


@query
def parse_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identifiers(spark, sf_dir).select(
        "page_id",
        ids.chat_name(F.col("raw")).alias("chat"),
        ids.chat_topic(F.col("raw"), F.col("explicit")).alias("topic"),
    )


@query
def parse_chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identifiers(spark, sf_dir).select(
        "page_id",
        ids.export_chat_name(F.col("raw")).alias("chat"),
        ids.export_chat_topic(F.col("raw")).alias("topic"),
    )


@query
def topic_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.msgs(spark, sf_dir)
    return m.select("id", ids.topic_or_none(F.col("topic_id")).alias("topic_id"))


@query
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _identifiers(spark, sf_dir)
    return named.select(
        "page_id",
        ids.safe_name(F.col("raw")).alias("safe"),
        ids.merged_name(F.col("raw")).alias("merged"),
        ids.export_base_name(F.col("raw"), F.col("explicit")).alias("base"),
    )


@query
def utc_order_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events")
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 4
    iso = (
        F.when(kind == 0, F.concat(local, F.lit("+00:00")))
        .when(kind == 1, F.concat(local, F.lit("+03:00")))
        .when(kind == 2, F.concat(local, F.lit("-05:30")))
        .otherwise(F.concat(F.lit("on "), local))
    )
    return zoneless(events.select("event_id", times.utc_order_key(iso).alias("order_key")))


@query
def iso_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.msgs(spark, sf_dir)
    return m.select("id", times.iso_text(F.col("date")).alias("date"), times.iso_text(F.col("edit_date")).alias("edit_date"))


# --- predicates -------------------------------------------------------------------


@query
def filter_chat_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.msgs(spark, sf_dir)
    return tables.scan_project(filters.in_chat(m, "click", -1)).unionByName(
        tables.scan_project(filters.in_chat(m, "view", 2))
    )


@query
def filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.visible(fx.msgs(spark, sf_dir))


@query
def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.corpus(spark, sf_dir).where(filters.has_text(F.col("text")))
    return c.select("source_name", "id", filters.has_words(F.col("text")).alias("has_words"))


@query
def min_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = filters.computed_once(fx.corpus(spark, sf_dir), "text", tx.clean_text(F.col("text")))
    return c.where(filters.worth_exporting(F.col("text"), min_chars=20)).select(
        "source_name", "id", F.length("text").cast("bigint").alias("chars")
    )


@query
def hashtag_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.corpus(spark, sf_dir)
    tagged = tx.hashtag_only(tx.clean_text(F.col("text")))
    return c.where(filters.has_text(F.col("text"))).select("source_name", "id", tagged.alias("hashtag_only"))


@query
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_project(filters.since(fx.msgs(spark, sf_dir), EDIT_CUTOFF))


@query
def change_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = current_table(spark, sf_dir), dedupe.dedupe_min_id(staged_rows(spark, sf_dir))
    pairs = old.select(*schema.KEY, F.struct(*old.columns).alias("old")).join(
        new.select(*schema.KEY, F.struct(*new.columns).alias("new")), list(schema.KEY)
    )
    return pairs.select(*schema.KEY, filters.row_changed("old", "new").alias("changed"))


# --- upserts ----------------------------------------------------------------------


@query
def new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = upsert.new_rows(staged_rows(spark, sf_dir), current_table(spark, sf_dir))
    return new.select("id", *schema.KEY)


@query
def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = upsert.known_rows(staged_rows(spark, sf_dir), current_table(spark, sf_dir))
    return known.select("id", *schema.KEY)


@query
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert_snapshot(current_table(spark, sf_dir), staged_rows(spark, sf_dir))


@query
def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert_changes(current_table(spark, sf_dir), staged_rows(spark, sf_dir))


@query
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.change_summary(upsert_changes(spark, sf_dir), _missing(spark, sf_dir))


@query
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.merge_sources(fx.corpus(spark, sf_dir))


@query
def merge_sources_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every key of two or more rows treated as a hot one."""
    return upsert.merge_sources(fx.corpus(spark, sf_dir), hot_rows=2)


@query
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.merge_counters(fx.corpus(spark, sf_dir))


@query
def merge_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_by_chat(fx.corpus(spark, sf_dir))


_HISTORY = [*schema.KEY, "source_order", "id", "version_no", "takes_effect"]


@query
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_history(fx.corpus(spark, sf_dir)).select(*_HISTORY)


@query
def version_history_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every key of two or more rows split into small ranges."""
    c = fx.corpus(spark, sf_dir)
    history = versions.version_history(c, versions.crowded_keys(c, hot_rows=2), ranges=40)
    return history.select(*_HISTORY)


def _known_and_seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = fx.msgs(spark, sf_dir)
    known = dedupe.dedupe_min_id(m)
    scanned = staged_rows(spark, sf_dir).withColumn("topic_id", ids.topic_or_none(F.col("topic_id")))
    seen = deletions.seen_ids(scanned.where("source_order = 1"), scanned.where("source_order = 2"))
    return known, seen, scanned_scopes(m, LAST_RUN)


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, seen, scopes = _known_and_seen(spark, sf_dir)
    return deletions.missing_messages(known, seen, scopes, earliest=LAST_RUN)


@query
def seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known_and_seen(spark, sf_dir)[1]


@query
def mark_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, seen, scopes = _known_and_seen(spark, sf_dir)
    return deletions.mark_deleted(known, seen, scopes, earliest=LAST_RUN).select(
        *[f.name for f in schema.MESSAGES]
    )


@query
def checkpoint_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.chronological_msgs(spark, sf_dir)
    normal = m.withColumn("topic_id", ids.topic_or_none(F.col("topic_id")))
    seen = deletions.seen_ids(raw.edit_rescan(normal, EDIT_CUTOFF))
    scopes = scanned_scopes(m, EDIT_CUTOFF)
    return deletions.checkpoint_update(earlier_checkpoints(spark, sf_dir), scopes, seen)


@query
def dedupe_min_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_min_id(fx.msgs(spark, sf_dir)).select(*[f.name for f in schema.MESSAGES])


@query
def edit_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    young = raw.edit_rescan(staged_rows(spark, sf_dir), EDIT_CUTOFF)
    return upsert.upsert_changes(current_table(spark, sf_dir), young)


def _sync(spark: SparkSession, sf_dir: str) -> SyncRun:
    """A whole run: increment, re-scan, upsert, deletions."""
    m = fx.chronological_msgs(spark, sf_dir)
    normal = m.withColumn("topic_id", ids.topic_or_none(F.col("topic_id")))
    columns = [f.name for f in schema.MESSAGES]
    known = normal.where("source_order <> 2").select(*columns)
    scanned = normal.where("source_order <> 1").select(*columns)
    return sync_run(
        known, earlier_checkpoints(spark, sf_dir), scanned, scanned_scopes(m, CUTOFF), CUTOFF
    )


@query
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir).summary


@query
def sync_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir).snapshot


@query
def sync_store_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run against a store, folded, run again in vain, and read back."""
    fx.use_utc(spark)
    m = fx.chronological_msgs(spark, sf_dir)
    normal = m.withColumn("topic_id", ids.topic_or_none(F.col("topic_id")))
    columns = [f.name for f in schema.MESSAGES]
    store = MessageStore(spark, scratch_path(spark), buckets=4, ids_per_range=250).create()
    store.write_base(_zoned(normal.where("source_order <> 2").select(*columns)))
    checkpoints = earlier_checkpoints(spark, sf_dir)
    known = checkpoints.withColumn("last_run_ts", F.col("last_run_ts").cast("timestamp"))
    nothing = spark.createDataFrame([], f"{schema.MESSAGES.simpleString()[7:-1]}, change_type:string")
    store.commit("sync", 0, nothing, known)
    scanned = _zoned(normal.where("source_order <> 1").select(*columns))
    scopes = _timestamps(scanned_scopes(m, CUTOFF), "cutoff", "run_ts")
    sync_store(store, 1, scanned, scopes, CUTOFF)
    sync_store(store, 1, scanned, scopes, CUTOFF)
    store.fold()
    return zoneless(store.current())


def _timestamps(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


# --- aggregates -------------------------------------------------------------------


@query
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_stats(fx.msgs(spark, sf_dir))


@query
def stats_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.listed_chats(fx.msgs(spark, sf_dir))


@query
def chat_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chat_profile(fx.msgs(spark, sf_dir))


def _deduped_csv(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.scan_project(dedupe.dedupe_csv(fx.corpus(spark, sf_dir), mode))

    return run


def _deduped_jsonl(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = dedupe.dedupe_jsonl(dedupe.cleaned(dedupe.candidates(fx.corpus(spark, sf_dir))), mode)
        return tables.scan_project(kept)

    return run


def _posts(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate.posts(fx.corpus(spark, sf_dir), mode)

    return run


for _mode in schema.DEDUPE_MODES:
    _suffix = _mode.replace("+", "_")
    QUERIES[f"dedupe_csv_{_suffix}"] = _deduped_csv(_mode)
    QUERIES[f"dedupe_jsonl_{_suffix}"] = _deduped_jsonl(_mode)
    QUERIES[f"agg_posts_{_suffix}"] = _posts(_mode)


@query
def agg_post_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some rows do not say where they come from.
    known = F.when(F.col("reply_to_msg_id").isNull(), F.col("message_id"))
    return aggregate.post_sources(fx.corpus(spark, sf_dir).withColumn("message_id", known))


@query
def agg_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.source_register(fx.corpus(spark, sf_dir))


@query
def agg_sources_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One source of the list has no rows.
    c = fx.corpus(spark, sf_dir)
    listed = c.select("source_name", "source_path", "source_order").distinct()
    return aggregate.source_register(c.where("source_name <> 'chat_1'"), listed)


@query
def agg_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and the number of their places, from rows that are hashed once."""
    made = aggregate_sources(fx.corpus(spark, sf_dir), "text+sender")
    places = made.post_sources.groupBy(F.col("post_id").alias("dedupe_hash")).agg(
        F.count(F.lit(1)).alias("places")
    )
    return made.posts.join(places, "dedupe_hash")


@query
def agg_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.aggregate_counters(fx.corpus(spark, sf_dir))


@query
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.merge_groups(fx.corpus(spark, sf_dir))


# --- streams and rates ------------------------------------------------------------


def _landed(events: DataFrame) -> DataFrame:
    m = events.sparkSession.sql(fx.MSGS, events=events)
    return m.select(
        F.col("date").cast("timestamp").alias("scanned_at"),
        "chat_id",
        "chat_identifier",
        "topic_id",
        F.col("message_id").alias("id"),
        F.col("date").cast("timestamp").alias("date"),
        F.col("edit_date").cast("timestamp").alias("edit_date"),
        F.col("text").alias("message"),
        F.when(F.col("is_service") == 1, F.create_map(F.lit("kind"), F.lit("pinned"))).alias("action"),
        "sender_id",
        F.struct(F.col("sender_username").alias("username")).alias("sender"),
        "reply_to_msg_id",
    )


def _streamed(spark: SparkSession, sf_dir: str, fold_after: int) -> MessageStore:
    """A store after all events, in four files that each hold every fourth event, one per trigger."""
    fx.use_utc(spark)
    folder = scratch_path(spark)
    events = fx.table(spark, sf_dir, "events").withColumn("slice", F.col("event_id") % 4)
    events.repartition("slice").write.partitionBy("slice").parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    store = MessageStore(spark, f"{folder}/store", buckets=4, ids_per_range=250).create()
    start_upsert(_landed(stream), store, f"{folder}/offsets", fold_after=fold_after).awaitTermination()
    return store


@query
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after streaming all events through the upsert, the log folded on the way."""
    store = _streamed(spark, sf_dir, fold_after=3)
    return zoneless(store.current().select(*schema.EXPORT_COLUMNS))


@query
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches of the same stream did."""
    counted = _streamed(spark, sf_dir, fold_after=100).counters()
    kinds = F.col("insert") + F.col("update") + F.col("revive") + F.col("unchanged")
    return counted.groupBy("writer").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("insert").alias("inserted"), F.sum(kinds).alias("touched")
    )


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")


@query
def rate_offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.offered_load(_rated(spark, sf_dir), "user_id", "ts", RATE_WINDOW)


@query
def rate_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir)
    return rates.rate_admitted(rated, "user_id", "ts", "event_id", RATE_LIMIT, RATE_WINDOW)


@query
def rate_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests the rule applies to, by path."""
    path = F.when(F.col("event_type") == "view", "/health").when(
        F.col("event_type") == "error", "/health/"
    )
    events = fx.table(spark, sf_dir, "events")
    requests = events.withColumn("path", F.coalesce(path, F.concat(F.lit("/"), "event_type")))
    return rates.not_exempt(requests).select("event_id", "path")


@query
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate evaluation of all events as a stream: three runs, each after a third of
    the time, with the state of the one before."""
    fx.use_utc(spark)
    folder = scratch_path(spark)
    events = fx.table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    for third in range(3):
        now = events.where(F.floor((micros - low) * 3 / (high - low + 1)) == third)
        now.write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        stream_rate_admitted(
            stream, "user_id", "ts", "event_id", f"{folder}/rates", RATE_LIMIT, RATE_WINDOW
        ).awaitTermination()
    return admitted_events(spark, f"{folder}/rates")


# --- quality, evolution, retention ------------------------------------------------


@query
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_null_violations(fx.msgs(spark, sf_dir))


@query
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(fx.msgs(spark, sf_dir))


@query
def dq_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Places of deleted posts, of which the posts table knows nothing.  Texts are hashed once.
    c = fx.corpus(spark, sf_dir)
    kept = settled(aggregate.kept_rows(c, include_deleted=True))
    return quality.broken_references(
        aggregate.places_of(kept),
        aggregate.posts_of(filters.visible(kept, include_service=True)),
        aggregate.source_register(c.where("source_name <> 'chat_1'")),
    )


@query
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.health_report(fx.corpus(spark, sf_dir))


@query
def health_report_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One source of the list has no rows.
    c = fx.corpus(spark, sf_dir)
    return quality.health_report(c.where("source_name <> 'chat_1'"), c.select("source_name"))


@query
def schema_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fx.msgs(spark, sf_dir).drop("edit_date", "deleted", "updated_at", "chat_id")
    return zoneless(evolution.schema_upgrade(old))


@query
def schema_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("event_id") % 5
    applied = fx.table(spark, sf_dir, "events").select(
        F.concat(F.lit("table_"), F.col("user_id").cast("string")).alias("table_name"),
        F.when((step > 0) & (step <= F.col("user_id") % 5), step).alias("version"),
    )
    return evolution.schema_status(applied)


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format(F.col("ts") - F.expr("INTERVAL 80 DAYS"), "yyyyMMdd_HHmmss")
    suffix = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("_"), stamp))
        .when(F.col("event_id") % 3 == 1, F.lit("_20231399_250000"))
        .otherwise(F.lit(""))
    )
    kind = (
        F.when(F.col("event_type") == "signup", "temp")
        .when(F.col("event_type") == "error", "logs")
        .when(F.col("event_type") == "click", "backups")
        .when(F.col("event_type") == "view", "archives")
        .otherwise("kept")
    )
    name = F.concat(F.lit("chat"), F.col("event_id").cast("string"), suffix, F.lit(".db"))
    events = fx.table(spark, sf_dir, "events")
    return events.select(name.alias("name"), kind.alias("kind"), F.col("ts").alias("mtime"))


@query
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.expired(_artifacts(spark, sf_dir), RETENTION_NOW)
