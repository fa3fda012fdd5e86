"""The set-based fold against upserting version after version."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadmill.operators import upsert, versions
from threadmill.operators.dedupe import dedupe_min_id
from threadmill.operators.deletions import checkpoint_update, mark_deleted, missing_messages
from threadmill.schema import COMPARED, KEY, MESSAGES

COLUMNS = MESSAGES.names
START = datetime(2024, 1, 1)
SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MESSAGES) + ", source_order int"


def random_versions(n: int, keys: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        when = START + timedelta(minutes=i)
        rows.append(
            {
                "id": i,
                "chat_id": rng.choice([None, 1, 2]),
                "chat_identifier": "room",
                "topic_id": rng.choice([None, -1, 5]),
                "message_id": rng.randrange(keys),
                "date": when,
                "edit_date": rng.choice([None, None, START]),
                "sender_id": rng.choice([None, -1, 3]),
                "sender_username": rng.choice([None, "", "ann"]),
                "text": rng.choice([None, "", "x"]),
                "reply_to_msg_id": rng.choice([None, -1]),
                "is_service": rng.choice([None, 0, 0, 1]),
                "deleted": rng.choice([None, 0, 0, 1]),
                "updated_at": when,
                "source_order": rng.randrange(4),
            }
        )
    return rows


def stands_for(row: dict) -> list:
    return [COMPARED[c] if row[c] is None else row[c] for c in COMPARED]


def one_by_one(rows: list[dict]) -> tuple[dict, list[str]]:
    """Table and, per row, what happened to it."""
    table: dict[tuple, dict] = {}
    events = []
    for row in sorted(rows, key=lambda r: (r["source_order"], r["id"])):
        row = dict(row, topic_id=-1 if row["topic_id"] is None else row["topic_id"])
        key = tuple(row[c] for c in KEY)
        old = table.get(key)
        if old is None:
            table[key] = row
            events.append("insert")
        elif stands_for(old) != stands_for(row) or old["deleted"]:
            table[key] = dict(row, id=old["id"], deleted=0)
            events.append("update")
        else:
            events.append("skip")
    return table, events


def frame(spark, rows):
    data = [tuple(r[c] for c in (*COLUMNS, "source_order")) for r in rows]
    return spark.createDataFrame(data, SCHEMA)


def as_table(df) -> dict:
    found = [r.asDict() for r in df.select(*COLUMNS).collect()]
    table = {tuple(r[c] for c in KEY): r for r in found}
    assert len(table) == len(found)
    return table


def expected_table(rows) -> dict:
    return {k: {c: r[c] for c in COLUMNS} for k, r in one_by_one(rows)[0].items()}


def test_merge_equals_one_by_one(spark):
    rows = random_versions(6000, 700, seed=5)
    merged = upsert.merge_sources(frame(spark, rows))
    assert as_table(merged) == expected_table(rows)


def test_merge_of_one_giant_key(spark):
    rows = random_versions(4000, 1, seed=6)
    sources = frame(spark, rows)
    hot = versions.crowded_keys(sources, hot_rows=100)
    assert hot.count() == 2
    folded = versions.fold_versions(sources, hot=hot, ranges=37)
    assert as_table(folded) == expected_table(rows)
    events = one_by_one(rows)[1]
    counts = upsert.merge_counters(sources, hot_rows=100).first()
    assert counts.asDict() == {
        "processed": len(rows),
        "inserted": events.count("insert"),
        "updated": events.count("update"),
        "skipped": events.count("skip"),
    }


def test_both_ways_number_alike(spark):
    sources = frame(spark, random_versions(3000, 40, seed=7))
    columns = [*KEY, "source_order", "id", "version_no", "takes_effect"]
    plain = versions.version_history(sources).select(*columns)
    hot = versions.crowded_keys(sources, hot_rows=30)
    split = versions.version_history(sources, hot, ranges=11).select(*columns)
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_crowded_increment_in_any_order(spark):
    rows = frame(spark, random_versions(2500, 3, seed=11)).drop("source_order")
    current, staged = rows.where("id % 50 = 0"), rows.where("id % 50 <> 0")
    current = dedupe_min_id(current)
    order = ("updated_at", "edit_date", "id")
    whole = upsert.upsert_changes(current, staged, order)
    split = upsert.upsert_changes(current, staged, order, hot_rows=100)
    assert whole.count() > 0
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()


def test_upsert_kinds_and_replay(spark):
    def row(i, **changes):
        base = dict.fromkeys(COLUMNS)
        base.update(id=i, chat_identifier="room", topic_id=-1, message_id=i, date=START, text="x")
        base.update(source_order=0, **changes)
        return base

    current = [
        row(1, deleted=0, chat_id=9),
        row(2, deleted=1),
        row(3, deleted=0),
        row(4, deleted=0),
        row(5, deleted=1),
    ]
    staged = [
        row(101, message_id=1, chat_id=1, sender_id=-1, sender_username=""),  # NULL = -1, NULL = ''
        row(102, message_id=2),
        row(103, message_id=3, text="y"),
        row(106, message_id=6, deleted=1),
    ]
    table, increment = frame(spark, current), frame(spark, staged).drop("source_order")
    changes = upsert.upsert_changes(table, increment)
    kinds = {r.message_id: r.change_type for r in changes.collect()}
    assert kinds == {1: "unchanged", 2: "revive", 3: "update", 6: "insert"}
    after = as_table(upsert.upsert_snapshot(table, increment))
    assert len(after) == 6
    by_id = {k[2]: r for k, r in after.items()}
    assert by_id[1]["chat_id"] == 9 and by_id[1]["sender_id"] is None
    assert [by_id[i]["deleted"] for i in range(1, 7)] == [0, 0, 0, 0, 1, 0]
    assert [by_id[i]["id"] for i in range(1, 7)] == [1, 2, 3, 4, 5, 106]
    again = upsert.upsert_changes(upsert.upsert_snapshot(table, increment), increment)
    assert {r.change_type for r in again.collect()} == {"unchanged"}
    assert upsert.change_summary(again).first().export_needed is False
    assert upsert.change_summary(changes).first().asDict() == {
        "inserted": 1, "updated": 1, "revived": 1, "deleted": 0, "unchanged": 1, "export_needed": True
    }


def test_upsert_applies_all_versions_of_an_increment(spark):
    rows = random_versions(2000, 300, seed=8)
    first = {}
    for r in rows:
        key = (r["topic_id"] if r["topic_id"] is not None else -1, r["message_id"])
        if r["source_order"] == 0 and key not in first:
            first[key] = dict(r, topic_id=key[0])
    current = list(first.values())
    staged = [dict(r, source_order=1, deleted=0) for r in rows if r["source_order"] != 0]
    got = upsert.upsert_snapshot(frame(spark, current), frame(spark, staged).drop("source_order"))
    assert as_table(got) == expected_table(current + staged)


def _scopes(spark, complete: bool):
    run, cutoff = datetime(2024, 2, 1), START
    return spark.createDataFrame(
        [("room", -1, cutoff, run, complete), ("silent", -1, cutoff, run, True)],
        "chat_identifier string, topic_id bigint, cutoff timestamp, run_ts timestamp, scan_complete boolean",
    )


def _known(spark):
    rows = []
    for chat, mid, day, deleted in [
        ("room", 1, 2, 0), ("room", 2, 2, 0), ("room", 3, 2, 1), ("silent", 1, 2, 0), ("other", 1, 2, 0)
    ]:
        row = dict.fromkeys(COLUMNS)
        row.update(id=len(rows), chat_identifier=chat, topic_id=-1, message_id=mid, deleted=deleted)
        row.update(date=datetime(2024, 1, day), source_order=0)
        rows.append(row)
    old = dict(rows[0], id=9, message_id=9, date=datetime(2023, 1, 1))
    return frame(spark, [*rows, old]).drop("source_order")


def test_deletions(spark):
    seen = spark.createDataFrame([("room", -1, 1)], "chat_identifier string, topic_id bigint, message_id bigint")
    known = _known(spark)
    # Not 1 (seen), 3 (already deleted), 9 (before the window), not the silent or unscanned chat.
    gone = missing_messages(known, seen, _scopes(spark, True)).collect()
    assert [(r.chat_identifier, r.message_id) for r in gone] == [("room", 2)]
    marked = mark_deleted(known, seen, _scopes(spark, True))
    assert marked.columns == known.columns and marked.count() == known.count()
    changed = [r for r in marked.where(F.col("updated_at").isNotNull()).collect()]
    assert [(r.message_id, r.deleted, r.updated_at) for r in changed] == [(2, 1, datetime(2024, 2, 1))]
    assert missing_messages(known, seen, _scopes(spark, False)).isEmpty()
    assert missing_messages(known, seen.limit(0), _scopes(spark, True)).isEmpty()


def test_checkpoints_never_move_back(spark):
    old = spark.createDataFrame(
        [("room", -1, 50, START), ("other", -1, 5, START)],
        "chat_identifier string, topic_id bigint, last_message_id bigint, last_run_ts timestamp",
    )
    seen = spark.createDataFrame(
        [("room", -1, 7)], "chat_identifier string, topic_id bigint, message_id bigint"
    )
    got = {r.chat_identifier: r for r in checkpoint_update(old, _scopes(spark, True), seen).collect()}
    assert {k: v.last_message_id for k, v in got.items()} == {"room": 50, "other": 5, "silent": 0}
    assert got["room"].last_run_ts == datetime(2024, 2, 1) and got["other"].last_run_ts == START
    cut_short = checkpoint_update(old, _scopes(spark, False), seen).where("chat_identifier = 'room'")
    assert cut_short.first().last_run_ts == START
