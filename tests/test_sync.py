"""Runs against a store, one after another."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadmill.plans.sync import sync_store
from threadmill.schema import MESSAGES
from threadmill.sinks.exports import jsonl_rows
from threadmill.sinks.store import MessageStore
from threadmill.sources.raw import flatten_raw

NOW = datetime(2024, 3, 31)
RAW_ROW = (
    "id bigint, date timestamp, edit_date timestamp, message string, action map<string,string>, "
    "sender_id bigint, sender struct<username string>, reply_to_msg_id bigint"
)


def scan(spark, run, messages):
    """What a scan on day `run` finds: {message id: text}; a message's id is its age in days."""
    rows = [
        (100 - age, NOW - timedelta(days=age), None, text, None, 5, ("ann",), None)
        for age, text in messages.items()
    ]
    raw = spark.createDataFrame(rows, RAW_ROW)
    return flatten_raw(
        raw, NOW + timedelta(days=run), F.lit(1), F.lit("room"), F.lit(None).cast("bigint")
    )


def scopes(spark, run, back=30, complete=True):
    row = ("room", -1, NOW - timedelta(days=back), NOW + timedelta(days=run), complete)
    return spark.createDataFrame(
        [row],
        "chat_identifier string, topic_id bigint, cutoff timestamp, run_ts timestamp, scan_complete boolean",
    )


def counts(run):
    return {k: v for k, v in run.summary.first().asDict().items() if v and k != "export_needed"}


def test_runs(spark, tmp_path):
    store = MessageStore(spark, str(tmp_path / "store"), buckets=2).create()
    cutoff = str(NOW - timedelta(days=30))

    first = sync_store(store, 0, scan(spark, 0, {40: "old", 20: "a", 10: "b", 5: "c"}), scopes(spark, 0), cutoff)
    assert counts(first) == {"inserted": 3}
    assert store.checkpoints().first().last_message_id == 95

    # 20 is edited, 10 is gone, 1 is new, 5 stays.
    found = {20: "a!", 5: "c", 1: "d"}
    second = sync_store(store, 1, scan(spark, 1, found), scopes(spark, 1), cutoff)
    assert counts(second) == {"inserted": 1, "updated": 1, "deleted": 1, "unchanged": 1}
    kept = store.current()
    assert {r.message_id: (r.text, r.deleted) for r in kept.collect()} == {
        80: ("a!", 0), 90: ("b", 1), 95: ("c", 0), 99: ("d", 0)
    }
    assert [r.text for r in jsonl_rows(kept).collect()] == ["a!", "c", "d"]
    assert store.checkpoints().first().last_message_id == 99

    # The same batch once more.
    again = sync_store(store, 1, scan(spark, 1, found), scopes(spark, 1), cutoff)
    assert counts(again) == counts(second)
    assert store.current().exceptAll(kept).isEmpty()

    # A scan cut short marks nothing; one that sees 90 again revives it.
    third = sync_store(store, 2, scan(spark, 2, {10: "b"}), scopes(spark, 2, complete=False), cutoff)
    assert counts(third) == {"revived": 1}
    assert store.checkpoints().first().last_run_ts == NOW + timedelta(days=1)
    assert store.current().where("deleted = 1").isEmpty()

    nothing = sync_store(
        store, 3, scan(spark, 3, {20: "a!", 10: "b", 5: "c", 1: "d"}), scopes(spark, 3), cutoff
    )
    assert counts(nothing) == {"unchanged": 4}
    assert nothing.summary.first().export_needed is False


def test_shorter_edit_window_deletes_only_inside_it(spark, tmp_path):
    store = MessageStore(spark, str(tmp_path / "store")).create()
    cutoff, recent = str(NOW - timedelta(days=30)), str(NOW - timedelta(days=7))
    sync_store(store, 0, scan(spark, 0, {20: "a", 5: "c", 4: "d"}), scopes(spark, 0), cutoff)
    run = sync_store(store, 1, scan(spark, 1, {5: "c"}), scopes(spark, 1, back=7), cutoff, recent)
    assert counts(run) == {"deleted": 1, "unchanged": 1}
    assert [r.message_id for r in store.current().where("deleted = 1").collect()] == [96]


def test_columns_of_the_store(spark, tmp_path):
    store = MessageStore(spark, str(tmp_path / "store")).create()
    assert store.current().schema.names == MESSAGES.names and store.current().isEmpty()
