"""The store: whole batches only, one number each, folds, and scans that touch what they need."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from threadmill.operators.upsert import upsert_changes
from threadmill.plans.sync import sync_store
from threadmill.schema import EXPORT_COLUMNS, KEY, MESSAGES
from threadmill.sinks.manifest import Conflict, Entry
from threadmill.sinks.store import MessageStore
from threadmill.streaming.ingest import ordered_changes

START = datetime(2024, 1, 1)


def row(mid, scan, text, chat="c", deleted=0):
    at = START + timedelta(hours=scan)
    return (None, 1, chat, -1, mid, START, None, None, None, text, None, 0, deleted, at)


def table(spark, rows):
    return spark.createDataFrame(rows, MESSAGES)


def texts(store, **kinds):
    return {(r.chat_identifier, r.message_id): r.text for r in store.current(**kinds).collect()}


def add(store, writer, batch, rows, seen=None):
    staged = table(store.spark, rows)
    changes = upsert_changes(store.current(near=staged), staged, ("updated_at",))
    return store.commit(writer, batch, changes, seen=seen)


@pytest.fixture
def store(spark, tmp_path):
    return MessageStore(spark, str(tmp_path / "store"), buckets=4, ids_per_range=10).create()


def test_batches_of_two_writers_keep_apart(store):
    add(store, "stream", 0, [row(1, 1, "a")])
    add(store, "sync", 1, [row(1, 2, "b"), row(2, 2, "x")])
    add(store, "stream", 1, [row(3, 3, "y")])
    assert texts(store) == {("c", 1): "b", ("c", 2): "x", ("c", 3): "y"}
    # The same batch once more, with other rows: it is there already.
    add(store, "sync", 1, [row(9, 9, "z")])
    assert len(texts(store)) == 3
    assert [(r.writer, r.batch, r["insert"], r["update"]) for r in store.counters().orderBy("number").collect()] == [
        ("stream", 0, 1, 0), ("sync", 1, 1, 1), ("stream", 1, 1, 0)
    ]


def test_a_batch_from_an_old_table_is_refused(store):
    seen = store.version()
    add(store, "a", 0, [row(1, 1, "a")], seen)
    with pytest.raises(Conflict):
        add(store, "b", 0, [row(1, 2, "b")], seen)
    assert texts(store) == {("c", 1): "a"}
    with pytest.raises(Conflict):
        store.manifest.commit(Entry(seen + 1, "batch", ["other"]))


def test_files_that_are_not_committed_do_not_count(store):
    add(store, "a", 0, [row(1, 1, "a")])
    changes = table(store.spark, [row(2, 2, "half")]).selectExpr("*", "'insert' AS change_type")
    store._write(changes.selectExpr("*", "null AS run", "null AS before"), "log", "pdead")
    assert texts(store) == {("c", 1): "a"}


def test_folds_rewrite_what_was_touched(store, spark):
    rng = random.Random(4)
    store.write_base(table(spark, [row(i, 0, "old", f"c{i % 5}") for i in range(100)]))
    want = texts(store)
    for batch in range(6):
        rows = [row(i, batch + 1, rng.choice("xyz"), f"c{i % 5}") for i in rng.sample(range(110), 4)]
        add(store, "w", batch, rows)
        want |= {(r[2], r[4]): r[9] for r in rows}
        before = texts(store)
        assert before == want
        if batch in (1, 2, 4):
            fold = store.fold()
            assert texts(store) == want and store.change_log().isEmpty()
            assert len(fold.parts) == len(set(fold.parts)) > 1
    assert store.fold() is not None and store.fold() is None
    assert texts(store) == want
    last = store.manifest.live()[0]
    rewritten = spark.read.parquet(f"{store.path}/base/part={last.parts[-1]}").count()
    assert 0 < rewritten < 110
    # Batches in the base are known to be there.
    assert store.applied("w", 3).kind == "fold"
    add(store, "w", 3, [row(1, 99, "again")])
    assert texts(store) == want


def test_a_batch_during_a_fold_stays_in_the_log(store, monkeypatch):
    add(store, "w", 0, [row(1, 1, "a"), row(2, 1, "b")])
    write = MessageStore._write_fold

    def slow(self, *args):
        write(self, *args)
        add(store, "w", 1, [row(2, 2, "c")])

    monkeypatch.setattr(MessageStore, "_write_fold", slow)
    store.fold()
    assert texts(store) == {("c", 1): "a", ("c", 2): "c"}
    assert [e.kind for e in store.manifest.live()] == ["fold", "batch"]


def test_a_table_as_of_an_entry(store):
    numbers = [add(store, "w", i, [row(1, i, str(i))]).number for i in range(3)]
    assert [texts(store, before=n + 1)[("c", 1)] for n in numbers] == ["0", "1", "2"]


def in_order(rows):
    """The row after all versions in the order of their scans, one by one."""
    state = None
    for r in sorted(rows, key=lambda r: r[13]):
        if state is None or r[9] != state[9]:
            state = r
    return (state[9], state[13])


@pytest.mark.parametrize("seed", range(4))
def test_late_versions_in_any_order(spark, store, seed):
    rng = random.Random(seed)
    rows = [row(k, scan, rng.choice("aab")) for k in range(12) for scan in rng.sample(range(12), rng.randint(1, 9))]
    shuffled = rng.sample(rows, len(rows))
    size = len(rows) // 5 + 1
    for batch, at in enumerate(range(0, len(rows), size)):
        staged = table(spark, shuffled[at : at + size])
        near = store.places(staged)
        store.commit("w", batch, ordered_changes(store.state(near=near), staged))
        if batch in (1, 3):
            store.fold()
    got = {r.message_id: (r.text, r.updated_at) for r in store.current().collect()}
    assert got == {k: in_order([r for r in rows if r[4] == k]) for k in {r[4] for r in rows}}
    kept = store.state().selectExpr("max(size(run)) AS n").first().n
    assert kept <= 9


def test_stream_and_sync_mixed(spark, store):
    """A late old scan of the stream does not undo a newer sync."""

    def stream(batch, rows):
        staged = table(spark, rows)
        store.commit("stream", batch, ordered_changes(store.state(near=store.places(staged)), staged))

    stream(0, [row(1, 1, "v1"), row(2, 1, "w1")])
    scopes = spark.createDataFrame(
        [("c", -1, START, START + timedelta(hours=50), True)],
        "chat_identifier string, topic_id bigint, cutoff timestamp, run_ts timestamp, scan_complete boolean",
    )
    sync_store(store, 1, table(spark, [row(1, 50, "v2")]), scopes, str(START))
    assert texts(store) == {("c", 1): "v2", ("c", 2): "w1"}
    assert [r.message_id for r in store.current().where("deleted = 1").collect()] == [2]
    stream(1, [row(1, 3, "late"), row(2, 3, "late"), row(3, 3, "new")])
    assert texts(store) == {("c", 1): "v2", ("c", 2): "w1", ("c", 3): "new"}
    stream(2, [row(1, 60, "v3"), row(2, 60, "w1")])
    assert texts(store) == {("c", 1): "v3", ("c", 2): "w1", ("c", 3): "new"}
    assert store.current().where("deleted = 1").isEmpty()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_by_places(spark, store):
    rows = [row(i, 0, "x", f"c{i % 9}") for i in range(900)]
    store.write_base(table(spark, rows))
    add(store, "w", 0, [row(5, 1, "y", "c5")])
    store.fold()
    add(store, "w", 1, [row(6, 1, "z", "c6")])
    near = store.places(table(spark, [row(5, 0, "", "c5"), row(6, 0, "", "c6")]))
    state = store.state(near=near)
    assert "dynamicpruning" in plan(state).lower()
    assert state.count() < 100
    scopes = spark.createDataFrame([("c5", -1)], "chat_identifier string, topic_id long")
    by_chat = store.state(near=store.places(scopes), since_date=str(START))
    text = plan(by_chat).lower()
    assert "dynamicpruning" in text and "greaterthanorequal(date" in text.replace(" ", "")
    assert {r.chat_identifier for r in by_chat.collect()} >= {"c5"} and by_chat.count() < 900


def folders(store, kind, part):
    return len(list(Path(store.path, kind, f"part={part}").glob("chat_bucket=*/*")))


def test_many_places_share_few_folders(spark, tmp_path):
    store = MessageStore(spark, str(tmp_path / "wide"), buckets=2, ids_per_range=1).create()
    store.write_base(table(spark, [row(i, 0, "x", f"c{i % 9}") for i in range(1500)]))
    changed = [row(i, 1, "y", f"c{i % 9}") for i in range(700, 1600)]
    batch = add(store, "w", 0, changed)
    assert 0 < folders(store, "base", store.manifest.live()[0].parts[0]) < 512
    assert 0 < folders(store, "log", batch.parts[0]) < 512
    want = {(f"c{i % 9}", i): "x" if i < 700 else "y" for i in range(1600)}
    assert texts(store) == want
    # Fine places in blocks, and of different levels, are still read alone.
    add(store, "w", 1, [row(-3, 1, "z", "c5")])
    near = table(spark, [row(5, 0, "", "c5"), row(-3, 0, "", "c5"), row(800, 0, "", "c8")])
    assert texts(store, near=near) == {("c5", 5): "x", ("c5", -3): "z", ("c8", 800): "y"}
    fold = store.fold()
    assert folders(store, "base", fold.parts[-1]) < 512
    assert spark.read.parquet(f"{store.path}/base/part={fold.parts[-1]}").count() == 901
    assert texts(store) == want | {("c5", -3): "z"}


def test_columns(store):
    assert store.current().schema.names == MESSAGES.names
    assert store.state().select(*KEY, *EXPORT_COLUMNS[:1]).isEmpty()
