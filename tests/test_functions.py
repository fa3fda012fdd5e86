"""Column functions against plain Python on hand-made and random input."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from threadmill.functions import identifiers as ids
from threadmill.functions import text as tx
from threadmill.functions import times
from threadmill.operators import filters

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    letters = ["a", "Z", "#", "é", "я", "😀", "\x7f", "​", "!", "~", "\x00"]
    breaks = ["\n", "\r", "\r\n", " ", "  "]
    pool = letters * 3 + breaks * 4 + SPACES
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def tidy_lines(text: str) -> str:
    lines = (" ".join(line.split()) for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return "\n".join(line for line in lines if line)


def evaluate(spark, texts, column):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(column).collect()]


def test_whitespace_class_is_pythons():
    assert len(SPACES) == 29


def test_normalize_text(spark):
    texts = [*random_texts(3000, 1), *SPACES, "", " \n "]
    got = evaluate(spark, texts, tx.normalize_text(F.col("t")))
    assert got == [" ".join(t.split()) for t in texts]
    assert evaluate(spark, [None], tx.normalize_text(F.col("t"))) == [""]


def test_clean_text(spark):
    texts = [*random_texts(3000, 2), *SPACES, "a\r\n\r\n b", " \n", "a \n \n b \n"]
    assert evaluate(spark, texts, tx.clean_text(F.col("t"))) == [tidy_lines(t) for t in texts]


def test_hashtag_only(spark):
    texts = [*random_texts(2000, 3), "#a #b", "#a\n#b", "#a b", "#", ""]
    got = evaluate(spark, texts, tx.hashtag_only(tx.clean_text(F.col("t"))))
    cleaned = [tidy_lines(t) for t in texts]
    assert got == [bool(c) and all(w.startswith("#") for w in c.split()) for c in cleaned]


def test_has_words(spark):
    texts = [*random_texts(1000, 4), "  \n", "\x1c", "."]
    assert evaluate(spark, texts, filters.has_words(F.col("t"))) == [bool(t.split()) for t in texts]


def test_long_runs_of_white_space_are_linear(spark):
    text = "a" + " \t" * 200_000 + "b" + "\n " * 200_000 + "c"
    assert evaluate(spark, [text], tx.clean_text(F.col("t"))) == ["a b\nc"]
    assert evaluate(spark, ["#a " * 100_000], tx.hashtag_only(tx.clean_text(F.col("t")))) == [True]


def test_min_chars_counts_code_points(spark):
    assert evaluate(spark, ["😀😀", "ab", "abc"], filters.worth_exporting(F.col("t"), 3)) == [False, False, True]


@pytest.mark.parametrize("null_sender", ["", "None"])
@pytest.mark.parametrize("mode", ["text", "text+sender", "text+sender+day"])
def test_dedupe_hash(spark, mode, null_sender):
    rows = [
        ("hi", 7, "ann", "2024-01-02 23:59:59"),
        ("hi", 7, "", "2024-01-02 23:59:59"),
        ("hi", 7, None, None),
        ("hi", None, None, "2024-01-02 00:00:00"),
        ("", None, "", None),
    ]
    df = spark.createDataFrame(rows, "text string, sid bigint, name string, d string")
    column = tx.dedupe_hash(
        F.col("text"), F.col("sid"), F.col("name"), F.col("d").cast("timestamp"), mode, null_sender
    )
    expected = []
    for text, sid, name, day in rows:
        parts = [text]
        if "sender" in mode:
            parts.append(name or (null_sender if sid is None else str(sid)))
        if "day" in mode:
            parts.append((day or "")[:10])
        expected.append(hashlib.sha256("\n".join(parts).encode()).hexdigest())
    assert [r[0] for r in df.select(column).collect()] == expected


def test_unknown_dedupe_mode_is_an_error():
    with pytest.raises(ValueError):
        tx.check_mode("sender")


@pytest.mark.parametrize(
    "raw, explicit, chat, topic",
    [
        ("some_channel", None, "some_channel", None),
        ("https://chat.example/some_channel/46679", None, "some_channel", 46679),
        ("some_channel", 123, "some_channel", 123),
        ("https://chat.example/some_channel/46679", 123, "some_channel", 123),
        ("  https://chat.example//room//+5?x=/9#/1 \n", None, "room", 5),
        ("http://chat.example/room/12.5", None, "room", None),
        ("http://chat.example/room/7;v=1", None, "room", 7),
        ("http://chat.example/", None, "http://chat.example/", None),
        ("http://", None, "http://", None),
        ("http://[bad/room/3", None, "room", 3),
        ("HTTP://chat.example/room/3", None, "HTTP://chat.example/room/3", None),
        ("@room", None, "@room", None),
        ("https://chat.example/room/99999999999999999999", None, "room", None),
        ("", None, "", None),
        (None, 4, None, 4),
    ],
)
def test_parse_chat(spark, raw, explicit, chat, topic):
    df = spark.createDataFrame([(raw, explicit)], "raw string, explicit bigint")
    row = df.select(
        ids.chat_name(F.col("raw")), ids.chat_topic(F.col("raw"), F.col("explicit"))
    ).first()
    assert tuple(row) == (chat, topic)


@pytest.mark.parametrize(
    "raw, chat, topic",
    [
        ("@room", "room", None),
        ("@@room", "@room", None),
        (" @https://chat.example/room/5", "room", 5),
        ("room", "room", None),
        (None, None, None),
    ],
)
def test_parse_chat_export(spark, raw, chat, topic):
    df = spark.createDataFrame([(raw,)], "raw string")
    row = df.select(ids.export_chat_name(F.col("raw")), ids.export_chat_topic(F.col("raw"))).first()
    assert tuple(row) == (chat, topic)


def test_topic_or_none(spark):
    df = spark.createDataFrame([(123,), (None,), (0,)], "t bigint")
    assert [r[0] for r in df.select(ids.topic_or_none(F.col("t"))).collect()] == [123, -1, 0]


def test_names(spark):
    texts = ["a b/c", "__..x..__", "я", "", "a__b", " -- "]
    assert evaluate(spark, texts, ids.safe_name(F.col("t"))) == ["a_b_c", "x", "export", "export", "a_b", "export"]
    assert evaluate(spark, ["a  b__c"], ids.merged_name(F.col("t"))) == ["a_b__c"]
    base = ids.export_base_name(F.col("t"), F.lit(7).cast("bigint"))
    assert evaluate(spark, ["room"], base) == ["room_7"]
    assert evaluate(spark, ["room"], ids.export_base_name(F.col("t"), F.lit(-1).cast("bigint"))) == ["room"]


def test_order_key(spark):
    texts = ["2024-01-01T00:30:00.9+03:00", "2023-12-31T21:30:00", "soon", "2024", None]
    got = evaluate(spark, texts, times.utc_order_key(F.col("t")).cast("string"))
    assert got == ["2023-12-31 21:30:00", "2023-12-31 21:30:00", None, None, None]


def test_iso_text(spark):
    texts = ["2024-01-01 00:00:00", "2024-01-01 00:00:00.000005", None]
    got = evaluate(spark, texts, times.iso_text(F.col("t").cast("timestamp")))
    assert got == ["2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.000005+00:00", None]


def test_artifact_time(spark):
    names = ["x_20240131_010203.db", "x.db", "x_20241399_000000.db"]
    modified = F.lit("2020-01-01 00:00:00").cast("timestamp")
    got = evaluate(spark, names, times.artifact_time(F.col("t"), modified).cast("string"))
    assert got == ["2024-01-31 01:02:03", "2020-01-01 00:00:00", None]
