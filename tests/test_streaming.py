"""Streamed ingest: any file order ends like the batch, and replays change nothing."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from threadmill.operators.upsert import upsert_changes
from threadmill.schema import EXPORT_COLUMNS, LANDED, MESSAGES
from threadmill.sinks.store import MessageStore
from threadmill.sources.raw import canonical_scope, flatten_raw, in_thread, read_landed
from threadmill.streaming.ingest import landed_stream, stream_upsert


def record(mid, scan, text, **changes):
    base = {
        "scanned_at": f"2024-02-01T00:00:{scan:02d}+00:00",
        "chat_id": 1,
        "chat_identifier": "@room",
        "id": mid,
        "date": f"2024-01-{1 + mid % 28:02d}T10:00:00+00:00",
        "message": text,
        "sender_id": mid % 5,
        "sender": {"username": f"u{mid % 3}"},
    }
    return {**base, **changes}


def landed_files():
    """Scan after scan: new messages, edits, repeats and copies."""
    rng = random.Random(1)
    files = []
    for scan in range(4):
        rows = []
        for mid in range(scan * 10, scan * 10 + 25):
            rows.append(record(mid, scan, rng.choice(["x", "y", None])))
        rows += rows[:5]
        rows.append(record(1000 + scan, scan, "service", action={"kind": "pin", "by": {"id": 5}}))
        rows.append(record(2000, scan, "no date", date=None))
        rows.append(record(3000, scan, "linked", chat_identifier="https://chat.example/room/7"))
        files.append(rows)
    return files


def write(folder, files, order):
    folder.mkdir()
    for name, i in enumerate(order):
        lines = "\n".join(json.dumps(r) for r in files[i])
        path = folder / f"{name:03d}.json"
        path.write_text(lines + "\n")
        # Files arrive in the order of their modification times.
        os.utime(path, (1_700_000_000 + name, 1_700_000_000 + name))


def run(spark, folder, store, tmp_path, per_trigger):
    landed = landed_stream(spark, str(folder), per_trigger)
    query = stream_upsert(landed, store, str(tmp_path / "offsets"))
    query.awaitTermination()
    return query


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*EXPORT_COLUMNS).collect()), key=repr)


def in_one_go(spark, folder):
    flat = canonical_scope(flatten_raw(read_landed(spark, str(folder)), F.col("scanned_at")))
    staged = flat.distinct().withColumn("id", F.lit(None).cast("bigint"))
    nothing = spark.createDataFrame([], MESSAGES)
    return upsert_changes(nothing, staged, ("updated_at", "edit_date"))


def test_stream_in_order_equals_batch(spark, tmp_path):
    files = landed_files()
    write(tmp_path / "in", files, range(len(files)))
    store = MessageStore(spark, str(tmp_path / "store"), buckets=2, ids_per_range=2000).create()
    query = run(spark, tmp_path / "in", store, tmp_path, per_trigger=1)
    assert len(query.recentProgress) >= len(files)
    expected = in_one_go(spark, tmp_path / "in")
    assert rows_of(store.current()) == rows_of(expected)
    current = store.current()
    assert current.where("message_id = 2000").isEmpty()
    linked = current.where("message_id = 3000").first()
    assert (linked.chat_identifier, linked.topic_id) == ("room", 7)
    assert current.where("message_id = 1002").first().is_service == 1
    checkpoints = {r.topic_id: r.last_message_id for r in store.checkpoints().collect()}
    assert checkpoints == {-1: 1003, 7: 3000}


@pytest.mark.parametrize("seed", [1, 2])
def test_files_of_one_trigger_may_come_in_any_order(spark, tmp_path, seed):
    files = landed_files()
    order = list(range(len(files)))
    random.Random(seed).shuffle(order)
    write(tmp_path / "in", files, order)
    store = MessageStore(spark, str(tmp_path / "store"), buckets=2, ids_per_range=2000).create()
    run(spark, tmp_path / "in", store, tmp_path, per_trigger=100)
    assert rows_of(store.current()) == rows_of(in_one_go(spark, tmp_path / "in"))


def test_replay_changes_nothing(spark, tmp_path):
    files = landed_files()
    write(tmp_path / "in", files, range(len(files)))
    store = MessageStore(spark, str(tmp_path / "store"), buckets=2, ids_per_range=2000).create()
    run(spark, tmp_path / "in", store, tmp_path, per_trigger=2)
    before, log = rows_of(store.current()), store.change_log().count()
    # As after a failure: the offsets are gone, the same batches come again.
    landed = landed_stream(spark, str(tmp_path / "in"), 2)
    stream_upsert(landed, store, str(tmp_path / "other_offsets")).awaitTermination()
    assert rows_of(store.current()) == before
    assert store.change_log().count() == log


def test_compaction_keeps_the_table(spark, tmp_path):
    files = landed_files()
    write(tmp_path / "in", files, range(len(files)))
    store = MessageStore(spark, str(tmp_path / "store"), buckets=2, ids_per_range=2000).create()
    run(spark, tmp_path / "in", store, tmp_path, per_trigger=2)
    compacted = store.compact(str(tmp_path / "compacted"))
    assert rows_of(compacted.current()) == rows_of(store.current())
    assert compacted.change_log().isEmpty()
    again = MessageStore(spark, str(tmp_path / "compacted")).create()
    assert rows_of(again.current()) == rows_of(store.current())


def test_late_rule_is_a_plain_filter(spark, tmp_path):
    files = landed_files()
    write(tmp_path / "in", files, [3, 2, 1, 0])
    store = MessageStore(spark, str(tmp_path / "store")).create()
    landed = landed_stream(spark, str(tmp_path / "in"), 1)
    stream_upsert(landed, store, str(tmp_path / "o"), cutoff="2024-01-15 00:00:00").awaitTermination()
    kept = {r.message_id for r in store.current().collect()}
    dated = {r["id"] for rows in files for r in rows if r["date"] and int(r["date"][8:10]) >= 15}
    assert kept == dated


def test_narrowing_reads_only_touched_partitions(spark, tmp_path):
    rows = [(i, 1, f"c{i % 9}", -1, i, None, None, None, None, "x", None, 0, 0, None) for i in range(900)]
    store = MessageStore(spark, str(tmp_path / "s"), buckets=8, ids_per_range=100).create()
    store.write_base(spark.createDataFrame(rows, MESSAGES))
    near = spark.createDataFrame(rows[:3], MESSAGES)
    part = store.current(near=near)
    assert 3 <= part.count() < 100
    assert store.current().count() == 900


def test_thread_scope(spark):
    df = spark.createDataFrame([], LANDED)
    assert in_thread(df, None) is df and in_thread(df, -1) is df
    some = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, reply_to_msg_id bigint")
    assert [r.id for r in in_thread(some, 5).collect()] == [1]


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("per_trigger", [1, 3])
def test_late_scans_go_to_their_place(spark, tmp_path, seed, per_trigger):
    files = landed_files()
    files += [[record(m, scan, t) for m, t in ((500, "a"), (501, "ab"[scan % 2]), (502, None))] for scan in (4, 5)]
    order = list(range(len(files)))
    random.Random(seed).shuffle(order)
    assert order != sorted(order)
    write(tmp_path / "in", files, order)
    store = MessageStore(spark, str(tmp_path / "store"), buckets=2, ids_per_range=2000).create()
    run(spark, tmp_path / "in", store, tmp_path, per_trigger)
    assert rows_of(store.current()) == rows_of(in_one_go(spark, tmp_path / "in"))


def test_scans_older_than_the_base_lose(spark, tmp_path):
    files = [[record(1, 5, "new"), record(2, 5, "x")], [record(1, 1, "old"), record(2, 9, "y")]]
    write(tmp_path / "in", files, [1])
    write(tmp_path / "base", files, [0])
    store = MessageStore(spark, str(tmp_path / "store"), buckets=2, ids_per_range=2000).create()
    store.write_base(in_one_go(spark, tmp_path / "base"))
    run(spark, tmp_path / "in", store, tmp_path, per_trigger=1)
    assert {r.message_id: r.text for r in store.current().collect()} == {1: "new", 2: "y"}
    assert {r.message_id: r.change_type for r in store.change_log().collect()} == {2: "update"}
