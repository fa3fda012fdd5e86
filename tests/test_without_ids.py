"""Answers without surrogate ids do not depend on how rows are laid out."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadmill.operators.aggregate import merge_groups, post_sources, posts
from threadmill.operators.dedupe import dedupe_min_id
from threadmill.operators.upsert import merge_counters, merge_sources
from threadmill.operators.versions import version_history
from threadmill.schema import MESSAGES


@pytest.fixture(scope="module", params=["none", "some"])
def rows(request, spark):
    """Two sources of one chat with edits of the same messages; no or some ids."""
    base = spark.range(240).select(
        F.when(F.lit(request.param == "some") & (F.col("id") % 3 > 0), F.col("id")).alias("id"),
        F.lit(1).cast("long").alias("chat_id"),
        F.lit("chat").alias("chat_identifier"),
        F.lit(None).cast("long").alias("topic_id"),
        F.when(F.col("id") % 40 > 2, F.col("id") % 6).alias("message_id"),
        F.timestamp_seconds(F.col("id") % 50 * 86400 + 1_700_000_000).alias("date"),
        (F.col("id") % 5).alias("sender_id"),
        F.concat(F.lit("text "), (F.col("id") % 9).cast("string")).alias("text"),
        F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("deleted"),
        (F.col("id") % 2).alias("source_order"),
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source_name"),
        F.lit("/p").alias("source_path"),
    )
    for f in MESSAGES.fields:
        value = F.col(f.name) if f.name in base.columns else F.lit(None)
        base = base.withColumn(f.name, value.cast(f.dataType))
    return base


def _counted(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


OPERATORS = {
    "posts": posts,
    "post_sources": post_sources,
    "merge_groups": merge_groups,
    "dedupe_min_id": dedupe_min_id,
    "version_history": version_history,
    "merge_sources": merge_sources,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_layout_does_not_matter(name, rows):
    run = OPERATORS[name]
    expected = _counted(run(rows.repartition(1)))
    assert expected
    for n in (3, 8):
        assert _counted(run(rows.repartition(n, F.rand(n)))) == expected


def test_hot_keys_give_the_same_answer(rows):
    assert _counted(merge_sources(rows, hot_rows=2)) == _counted(merge_sources(rows, hot_rows=10_000))
    assert _counted(merge_counters(rows, hot_rows=2)) == _counted(merge_counters(rows, hot_rows=10_000))


def test_sources_without_ids_are_merged(rows):
    got = {(r.chat_identifier, r.source_name, r.source_count) for r in merge_groups(rows).collect()}
    assert got == {("chat", "s0", 2), ("chat", "s1", 2)}


def test_rows_without_a_place_stay_apart(rows):
    nowhere = rows.where("message_id IS NULL AND deleted = 0 AND chat_identifier IS NOT NULL")
    found = post_sources(rows).where("message_id IS NULL")
    assert found.count() == nowhere.count() > 0
