"""Written files, byte by byte where it matters."""

from __future__ import annotations

import csv
import glob
import io
import json
from datetime import datetime, timedelta

from threadmill.plans.sync import export_if_changed
from threadmill.schema import EXPORT_COLUMNS, JSONL_FIELDS, MESSAGES
from threadmill.sinks import exports

TEXTS = [
    'say "hi", friend',
    "two\nlines\r\nand\rmore",
    "  spaces at both ends  ",
    "я / 😀 \\ tab\t",
    "",
    None,
    "#tag #only",
    " \n ",
    '"',
]


def messages(spark):
    rows = []
    for i, text in enumerate(TEXTS):
        when = datetime(2024, 1, 1) + timedelta(days=10 - i)
        rows.append((i, None, "room", -1, i, when, None, None, None, text, None, 0, 0, when))
    rows.append((90, 1, "room", 4, 90, None, None, 7, "ann", "no date", 3, None, None, None))
    rows.append((91, 1, "room", 4, 91, datetime(2024, 1, 5), None, 7, "ann", "gone", 3, 0, 1, None))
    rows.append((92, 1, "room", 4, 92, datetime(2024, 1, 5), None, 7, "ann", "joined", 3, 1, 0, None))
    return spark.createDataFrame(rows, MESSAGES).repartition(4)


def parts(path, suffix):
    return [open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*{suffix}"))]


def test_csv(spark, tmp_path):
    path = str(tmp_path / "csv")
    exports.write_csv(messages(spark), path)
    rows = []
    for data in parts(path, ".txt"):
        assert data.startswith(b"\xef\xbb\xbfchat_id,chat_identifier,")
        assert data.endswith(b"\r\n")
        lines = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
        again = io.StringIO(newline="")
        csv.writer(again).writerows(lines)
        assert again.getvalue() == data.decode("utf-8-sig")
        assert lines[0] == EXPORT_COLUMNS
        rows += lines[1:]
    # Unknown date first, then by date.
    assert [r[3] for r in rows][0] == "90"
    dates = [r[4] for r in rows]
    assert dates == sorted(dates)
    texts = {int(r[3]): r[8] for r in rows}
    assert [texts[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    first = next(r for r in rows if r[3] == "0")
    assert first[0] == "" and first[4] == "2024-01-11T00:00:00+00:00" and first[11] == "0"


def test_csv_of_nothing(spark, tmp_path):
    path = str(tmp_path / "csv")
    exports.write_csv(messages(spark).where("false"), path)
    assert parts(path, ".txt") == [b"\xef\xbb\xbf" + ",".join(EXPORT_COLUMNS).encode() + b"\r\n"]


def test_csv_append(spark, tmp_path):
    path = str(tmp_path / "csv")
    exports.write_csv(messages(spark).where("id < 3"), path)
    exports.append_csv(messages(spark).where("id >= 3"), path)
    rows = []
    for data in parts(path, ".txt"):
        rows += list(csv.DictReader(io.StringIO(data.decode("utf-8-sig"), newline="")))
    assert len(rows) == messages(spark).count()
    assert sum(d.startswith(b"\xef\xbb\xbf") for d in parts(path, ".txt")) < len(parts(path, ".txt"))


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "jsonl")
    exports.write_jsonl(exports.jsonl_rows(messages(spark)), path)
    data = b"".join(parts(path, ".txt")).decode()
    lines = [json.loads(x) for x in data.splitlines()]
    assert all(list(x) == JSONL_FIELDS for x in lines)
    assert [x["message_id"] for x in lines] == [90, 8, 7, 6, 3, 2, 1, 0]
    by_id = {x["message_id"]: x for x in lines}
    assert by_id[1]["text"] == "two\nlines\nand\nmore"
    assert by_id[7]["text"] == ""
    assert by_id[3]["sender_id"] is None and by_id[3]["edit_date"] is None
    assert by_id[90]["deleted"] is False and by_id[90]["date"] is None
    assert "я / 😀 \\\\ tab" in data


def test_jsonl_options(spark):
    def kept(**options):
        return [r.message_id for r in exports.jsonl_rows(messages(spark), **options).collect()]

    assert kept(min_chars=1) == [90, 8, 6, 3, 2, 1, 0]
    assert kept(skip_hashtag_only=True) == [90, 8, 7, 3, 2, 1, 0]
    assert kept(include_deleted=True, topic_id=4) == [90, 91]
    assert kept(include_service=True, topic_id=4) == [90, 92]
    assert kept(topic_id=-1, chat_identifier="room") == [8, 7, 6, 3, 2, 1, 0]
    assert kept(chat_identifier="nowhere") == []


def test_jsonl_keeps_the_first_copy(spark):
    rows = [
        (i, None, "room", -1, i, datetime(2024, 1, day), None, None, name, text, None, 0, 0, None)
        for i, (day, name, text) in enumerate(
            [(3, "ann", "a  b"), (2, "bob", " a b"), (2, "ann", "a b\n"), (1, "ann", "a\nb")]
        )
    ]
    df = spark.createDataFrame(rows, MESSAGES)

    def kept(mode):
        return [r.message_id for r in exports.jsonl_rows(df, dedupe=mode).collect()]

    assert kept("text") == [3, 1]
    assert kept("text+sender") == [3, 1, 2]
    assert kept("text+sender+day") == [3, 1, 2, 0]
    # The spreadsheet export takes line breaks for spaces.
    assert [r.message_id for r in exports.csv_rows(df, "text").collect()] == [3]


def test_exports_follow_changes(spark, tmp_path):
    summary = spark.createDataFrame([(False,)], "export_needed boolean")
    assert not export_if_changed(summary, messages(spark), str(tmp_path / "c"), str(tmp_path / "j"))
    assert not (tmp_path / "c").exists()
    summary = spark.createDataFrame([(True,)], "export_needed boolean")
    assert export_if_changed(summary, messages(spark), str(tmp_path / "c"), str(tmp_path / "j"))
    assert (tmp_path / "c" / "_SUCCESS").exists() and (tmp_path / "j" / "_SUCCESS").exists()
