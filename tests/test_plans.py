"""Physical plans: what must, and must not, be in them."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, queries
from threadmill.operators import filters
from threadmill.operators.upsert import merge_sources, upsert_changes, upsert_snapshot
from threadmill.sinks.exports import jsonl_rows
from threadmill.testing import fixtures as fx
from threadmill.testing.queries import QUERIES

# These run jobs, or streams, of their own while being built.
WRITERS = {"csv_written", "csv_appended", "jsonl_written", "snapshot_write", "stream_upsert", "stream_rate", "merge_chats", "sync_snapshot", "sync_summary"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    return {n: plan(q(spark, sf_dir)) for n, q in queries().items() if n not in WRITERS}


def test_no_cross_joins(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_no_window_over_everything(plans):
    for name, text in plans.items():
        for window in re.findall(r"Window \[[^\n]*\n[^\n]*\n[^\n]*", text):
            assert "SinglePartition" not in window, name


def test_python_only_where_state_is_carried(plans):
    with_python = {n for n, text in plans.items() if "Python" in text or "InArrow" in text or "InPandas" in text}
    # The operators for training data are free to use Python, but for those that are native.
    assert not with_python & {"op1_byte_shards", "op4_mix_sources"}
    assert with_python & set(QUERIES) == {"rate_admitted"}


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "messages")
    fx.msgs(spark, sf_dir).write.parquet(path)
    stored = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    text = plan(jsonl_rows(filters.since(stored, "2024-01-20 00:00:00"), "click", 2))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text, re.S).group(1)
    for wanted in ("chat_identifier,click", "topic_id,2", "date,2024-01-20", "deleted,0", "is_service,0"):
        assert wanted in pushed.replace(", ", ","), wanted
    read = re.search(r"ReadSchema: (struct<[^\n]*)", text).group(1)
    assert "updated_at" not in read and "chat_id:" not in read


def test_merge_shuffles_once_without_hot_keys(spark, sf_dir):
    merged = merge_sources(fx.msgs(spark, sf_dir))
    merged.collect()
    final = plan(merged).split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1
    assert "Join" not in final


def test_small_increment_does_not_shuffle_the_table(spark, sf_dir, tmp_path):
    path = str(tmp_path / "table")
    from threadmill.operators.dedupe import dedupe_min_id

    dedupe_min_id(fx.msgs(spark, sf_dir)).write.parquet(path)
    table = spark.read.parquet(path)
    changes = upsert_changes(table, table.where("message_id = 5"))
    changes.collect()
    final = plan(changes).split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final and "BroadcastHashJoin" in final


def test_large_increment_shuffles_the_table_once(spark, sf_dir, tmp_path):
    from threadmill.operators.dedupe import dedupe_min_id

    path = str(tmp_path / "stored")
    dedupe_min_id(fx.msgs(spark, sf_dir)).write.parquet(path)
    table, staged = spark.read.parquet(path), fx.msgs(spark, sf_dir)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The increment, its keys and the table; for the new keys once more the increment, and keys of both.
        for upserted, exchanges in ((upsert_changes(table, staged), 3), (upsert_snapshot(table, staged), 5)):
            text = plan(upserted)
            scans = [at for at in text.split("\n") if "FileScan" in at and "/stored" in at]
            assert sum("text:string" in at for at in scans) == 1
            assert text.count("Exchange hashpartitioning") == exchanges
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cleaning_happens_once_per_row(spark, sf_dir):
    text = plan(jsonl_rows(fx.msgs(spark, sf_dir), min_chars=3, skip_hashtag_only=True))
    body = text.split("== Initial Plan ==")[0]
    # One cleaning is three replacements, of which two by pattern.
    assert body.count("regexp_replace(regexp_replace(") == 1


def test_checkpoints_reach_the_scan(spark, tmp_path):
    from threadmill.sources.raw import incremental_scan

    path = str(tmp_path / "scanned")
    rows = [(c, t, m) for c in ("a", "b", None) for t in (None, -1, 0, 7) for m in (None, 1, 5, 6, 9)]
    spark.createDataFrame(rows, "chat_identifier string, topic_id bigint, message_id bigint").write.parquet(path)
    ends = {("a", -1): 5, ("a", 7): 6, ("b", 0): 9, (None, -1): 9, ("b", None): 9, ("c", 7): 0}
    checkpoints = spark.createDataFrame(
        [(c, t, last) for (c, t), last in ends.items()],
        "chat_identifier string, topic_id bigint, last_message_id bigint",
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    found = incremental_scan(spark.read.parquet(path), checkpoints)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan(found), re.S).group(1)
    for bound in ("GreaterThan(message_id,5)", "GreaterThan(message_id,6)", "GreaterThan(message_id,9)"):
        assert bound in pushed, bound

    normal = [(c, -1 if t is None else t, m) for c, t, m in rows if m is not None]
    expected = [r for r in normal if r[2] > (ends.get(r[:2], 0) if r[0] else 0)]
    key = str
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
