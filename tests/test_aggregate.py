"""Aggregation, merging and quality checks against row-by-row Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadmill.functions.text import dedupe_hash
from threadmill.operators import aggregate, quality, retention
from threadmill.operators.dedupe import dedupe_min_id
from threadmill.operators.evolution import schema_status, schema_upgrade, tolerant_scan
from threadmill.operators.stats import chat_profile, listed_chats, table_stats
from threadmill.plans.aggregate import aggregate_sources, merge_by_chat
from threadmill.schema import MESSAGES
from threadmill.sources.files import file_catalog, source_catalog
from threadmill.sources.tables import given_sources, multi_source_scan, read_source_folders, read_sources

START = datetime(2024, 1, 1)


def source_rows(seed: int, n: int = 400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        when = rng.choice([None, START + timedelta(days=rng.randrange(20))])
        rows.append(
            (
                i,
                None,
                rng.choice(["room", "hall", None]),
                rng.choice([None, -1, 3]),
                rng.choice([None, rng.randrange(40)]),
                when,
                None,
                rng.choice([None, 5]),
                rng.choice([None, "", "ann"]),
                rng.choice([None, "", "  ", "a", " a ", "b\nc", "b c", "d"]),
                None,
                0,
                rng.choice([None, 0, 1]),
                when,
            )
        )
    return rows


def scanned(spark):
    tables = [("one", "/p/1", 1), ("two", "/p/2", 2), ("one", "/p/other", 3)]
    frames = [(n, p, spark.createDataFrame(source_rows(s), MESSAGES)) for n, p, s in tables]
    return multi_source_scan(frames), [(n, p, source_rows(s)) for n, p, s in tables]


def row_by_row(tables):
    posts, places, register, read, kept = {}, {}, {}, 0, 0
    apart = 0
    for name, path, rows in tables:
        register.setdefault(name, path)
        for r in rows:
            read += 1
            _, _, chat, topic, mid, date, _, sid, sender, text, _, _, deleted, _ = r
            words = " ".join((text or "").split())
            if deleted or not words:
                continue
            kept += 1
            if words not in posts:
                posts[words] = [date, date, sid, sender]
            elif date is not None and posts[words][1] is not None and date > posts[words][1]:
                posts[words][1] = date
            place = (words, name, chat, -1 if topic is None else topic, mid)
            if chat is None or mid is None:
                apart += 1
                place = (*place, apart)
            places.setdefault(place, date)
    return posts, places, register, read, kept


def test_aggregate_equals_row_by_row(spark):
    df, tables = scanned(spark)
    result = aggregate_sources(df)
    posts, places, register, read, kept = row_by_row(tables)
    got = {r.text: [r.first_date, r.last_date, r.sender_id, r.sender_username] for r in result.posts.collect()}
    assert got == posts
    words = {r.dedupe_hash: r.text for r in result.posts.collect()}
    found = sorted(
        (
            (words[r.post_id], r.source_name, r.chat_identifier, r.topic_id, r.message_id, r.date)
            for r in result.post_sources.collect()
        ),
        key=repr,
    )
    assert found == sorted(((*k[:5], d) for k, d in places.items()), key=repr)
    assert {r.source_name: r.source_path for r in result.sources.collect()} == register
    counters = result.counters.first()
    assert (counters.rows_read, counters.rows_kept, counters.unique_posts) == (read, kept, len(posts))
    broken = quality.broken_references(result.post_sources, result.posts, result.sources)
    assert broken.isEmpty()
    some = quality.broken_references(
        result.post_sources, result.posts.where("text <> 'a'"), result.sources.where("source_name = 'one'")
    )
    assert {r.reference for r in some.collect()} == {"post_id", "source_name"}


def test_deleted_rows_on_request(spark):
    df, _ = scanned(spark)
    assert aggregate.posts(df, include_deleted=True).count() >= aggregate.posts(df).count()
    with_deleted = aggregate.aggregate_counters(df, include_deleted=True).first().rows_kept
    assert with_deleted > aggregate.aggregate_counters(df).first().rows_kept


def test_hash_of_aggregate_has_empty_missing_sender(spark):
    df, _ = scanned(spark)
    nobody = df.where("sender_id IS NULL AND coalesce(sender_username, '') = '' AND text = 'a'")
    nobody = nobody.where("coalesce(deleted, 0) = 0")
    got = {r.dedupe_hash for r in aggregate.posts(nobody, "text+sender").collect()}
    empty = F.lit(None).cast("bigint"), F.lit("").alias("n"), F.lit(None).cast("timestamp")
    expected = spark.range(1).select(dedupe_hash(F.lit("a"), *empty, "text+sender", "")).first()[0]
    assert got == {expected}


def test_merge_by_chat(spark):
    def rows(chat_of_first, *others):
        base = [None] * len(MESSAGES)
        out = []
        for i, chat in enumerate((chat_of_first, *others)):
            row = list(base)
            row[0], row[2], row[3], row[4], row[9] = i, chat, -1, i, f"{chat_of_first}{i}"
            out.append(tuple(row))
        return spark.createDataFrame(out, MESSAGES)

    sources = multi_source_scan(
        [("a", "", rows("room", "hall")), ("b", "", rows("room", "hall", "room")), ("c", "", rows("hall"))]
    )
    groups = aggregate.merge_groups(sources).collect()
    assert sorted((r.chat_identifier, r.source_name, r.source_count) for r in groups) == [
        ("room", "a", 2),
        ("room", "b", 2),
    ]
    merged = sorted((r.merged_into, r.chat_identifier, r.message_id) for r in merge_by_chat(sources).collect())
    assert merged == [("room", "hall", 1), ("room", "room", 0), ("room", "room", 2)]


def test_old_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "room", 5, "x")], "id bigint, chat_identifier string, message_id bigint, text string")
    assert tolerant_scan(old).first().asDict() == {
        "chat_identifier": "room",
        "topic_id": -1,
        "message_id": 5,
        "date": None,
        "sender_id": None,
        "sender_username": None,
        "text": "x",
        "deleted": 0,
    }
    assert schema_upgrade(old).schema.names == MESSAGES.names
    nulls = spark.createDataFrame([(None,)], "topic_id bigint")
    assert tolerant_scan(nulls).first().topic_id is None
    assert schema_upgrade(nulls).first().topic_id == -1
    path = str(tmp_path / "old")
    old.write.parquet(path)
    assert read_sources(spark, [("s", path)]).first().source_path == path


def test_source_folders_are_one_scan(spark, tmp_path):
    root = str(tmp_path / "sources")
    new = spark.createDataFrame(source_rows(1), MESSAGES)
    old = new.select("id", "chat_identifier", "message_id", "date", "text")
    new.write.parquet(f"{root}/source_name=new")
    old.write.parquet(f"{root}/source_name=old")
    new.write.parquet(f"{root}/source_name=other")
    got = read_source_folders(spark, root, ["old", "new"])
    expected = multi_source_scan(
        [
            ("old", f"{root}/source_name=old", old),
            # A NULL flag means the same as 0 everywhere.
            ("new", f"{root}/source_name=new", new.fillna(0, ["deleted"])),
        ]
    )
    assert got.columns == expected.columns
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 1


def test_min_id_wins(spark):
    rows = [(3, "room", None, 1), (2, "room", -1, 1), (1, "room", 0, 1), (4, "hall", None, 1)]
    df = spark.createDataFrame(rows, "id bigint, chat_identifier string, topic_id bigint, message_id bigint")
    assert sorted(r.id for r in dedupe_min_id(df).collect()) == [1, 2, 4]


def test_quality(spark):
    df, tables = scanned(spark)
    nulls = quality.not_null_violations(df).first()
    everything = [r for _, _, rows in tables for r in rows]
    assert nulls.null_date == sum(r[5] is None for r in everything)
    report = {r.source_name: r for r in quality.health_report(df).collect()}
    assert report["two"].message_count == 400 and report["two"].status == "warning"
    clean = spark.createDataFrame(
        [(i, 1, "room", -1, i, START, None, None, None, "x", None, 0, 0, START) for i in range(3)], MESSAGES
    )
    healthy = quality.health_report(multi_source_scan([("s", "", clean)])).first()
    assert (healthy.status, healthy.duplicate_keys, healthy.incomplete_rows) == ("healthy", 0, 0)
    assert quality.duplicate_keys(clean).isEmpty()
    assert quality.duplicate_keys(clean.union(clean)).count() == 3


def test_stats(spark):
    df, tables = scanned(spark)
    everything = [r for _, _, rows in tables for r in rows]
    dates = [r[5] for r in everything if r[5]]
    assert tuple(table_stats(df).first()) == (len(everything), min(dates), max(dates))
    assert listed_chats(df, 4).count() == 4
    profile = {r.chat_identifier: r for r in chat_profile(df).collect()}
    assert profile["room"].earliest_month == "2024-01"
    assert profile["room"].latest_message_id == max(r[4] for r in everything if r[2] == "room" and r[4] is not None)


def test_schema_status(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), ("c", 4)], "table_name string, version int")
    got = {r.table_name: r for r in schema_status(df).collect()}
    assert got["a"].pending == "add_deleted_column,add_updated_at_column" and got["a"].pending_count == 2
    assert (got["b"].current_version, got["b"].pending_count, got["b"].up_to_date) == (0, 4, False)
    assert (got["c"].pending, got["c"].pending_count, got["c"].up_to_date) == ("", 0, True)


def test_retention(spark):
    now = datetime(2024, 6, 1)

    def days(n):
        return now - timedelta(days=n)

    rows = [
        ("temp_a.db", "temp", days(8)),
        ("temp_b.db", "temp", days(7)),
        ("x.log", "logs", days(31)),
        ("y.log", "logs", days(30)),
        ("b_20200101_000000.db", "backups", days(1)),
        ("c_20200101_000000.db", "archives", days(1)),
        ("d_20201399_000000.db", "archives", days(999)),
        ("e.db", "archives", days(91)),
        ("f.db", "other", days(999)),
    ]
    df = spark.createDataFrame(rows, "name string, kind string, mtime timestamp")
    assert sorted(r.name for r in retention.expired(df, now).collect()) == [
        "c_20200101_000000.db", "e.db", "temp_a.db", "x.log"
    ]
    assert "y.log" in [r.name for r in retention.expired(df, now, {"logs": 29}).collect()]


def test_file_and_source_catalogs(spark, tmp_path):
    (tmp_path / "exports").mkdir()
    for name in ("a.db", "A_Backup.db", "exports/b.db", "exports/old_ARCHIVE.db", "exports/a.db", "c.csv"):
        (tmp_path / name).write_bytes(b"x" * 1_572_864)
    files = file_catalog(spark, str(tmp_path), "*.db")
    assert files.count() == 5
    first = files.first()
    assert (first.bytes, first.size_mb) == (1_572_864, 1.5)
    names = source_catalog(files.withColumnRenamed("name", "source_name"))
    assert [r.source_name for r in names.collect()] == ["a.db", "b.db"]


def test_sources_without_rows_are_listed(spark):
    df, tables = scanned(spark)
    given = given_sources(spark, [*((n, p) for n, p, _ in tables), ("empty", "/p/empty")])
    made = aggregate_sources(df, given=given)
    assert {r.source_name: r.source_path for r in made.sources.collect()} == {
        "one": "/p/1", "two": "/p/2", "empty": "/p/empty"
    }
    report = {r.source_name: r for r in quality.health_report(df, given).collect()}
    empty = report.pop("empty")
    assert (empty.status, empty.message_count, empty.earliest_date) == ("healthy", 0, None)
    assert report == {r.source_name: r for r in quality.health_report(df).collect()}
    nothing = quality.health_report(df.where("false"), given).collect()
    assert {r.source_name: r.message_count for r in nothing} == {"one": 0, "two": 0, "empty": 0}
