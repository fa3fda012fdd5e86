"""Tables, keys and NULL conventions shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names, their order, defaults and stand-ins ---------

KEY = ("chat_identifier", "topic_id", "message_id")

SCOPE = ("chat_identifier", "topic_id")

NO_TOPIC = -1

MESSAGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("chat_id", T.LongType()),
        T.StructField("chat_identifier", T.StringType()),
        T.StructField("topic_id", T.LongType()),
        T.StructField("message_id", T.LongType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("edit_date", T.TimestampType()),
        T.StructField("sender_id", T.LongType()),
        T.StructField("sender_username", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("reply_to_msg_id", T.LongType()),
        T.StructField("is_service", T.IntegerType()),
        T.StructField("deleted", T.IntegerType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# Everything but the surrogate id: the row a table exchanges with the outside.
EXPORT_COLUMNS = [f.name for f in MESSAGES if f.name != "id"]

# Fields of one exported JSON object; `chat` renames chat_identifier and `text`
# holds the cleaned text.
JSONL_FIELDS = [
    "chat",
    "topic_id",
    "message_id",
    "date",
    "edit_date",
    "sender_id",
    "sender_username",
    "reply_to_msg_id",
    "is_service",
    "deleted",
    "text",
]

# Columns whose change makes a new version of a message, each with the value
# NULL stands for.  `edit_date` is typed, so a null-safe comparison is enough.
COMPARED = {
    "edit_date": None,
    "text": "",
    "sender_id": -1,
    "sender_username": "",
    "reply_to_msg_id": -1,
    "is_service": 0,
}

# What a column holds in an older table that lacks it.
MISSING_DEFAULTS = {"topic_id": NO_TOPIC, "deleted": 0}

# Schema versions in order: (version, name, column it adds).
SCHEMA_VERSIONS = [
    (1, "add_topic_id_column", "topic_id"),
    (2, "add_edit_date_column", "edit_date"),
    (3, "add_deleted_column", "deleted"),
    (4, "add_updated_at_column", "updated_at"),
]

# Days an artifact of a class is kept, and whether a stamp in its name dates it.
RETENTION_RULES = [
    ("temp", 7, False),
    ("logs", 30, False),
    ("backups", 30, False),
    ("archives", 90, True),
]

DEDUPE_MODES = ("text", "text+sender", "text+sender+day")

# ------------------------------------------------------------------------------

RAW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("edit_date", T.TimestampType()),
        T.StructField("message", T.StringType()),
        # Only its presence counts, so any object maps onto a string map.
        T.StructField("action", T.MapType(T.StringType(), T.StringType())),
        T.StructField("sender_id", T.LongType()),
        T.StructField("sender", T.StructType([T.StructField("username", T.StringType())])),
        T.StructField("reply_to_msg_id", T.LongType()),
    ]
)

# A landed record also says when and from which chat it was read.
LANDED = T.StructType(
    [
        T.StructField("scanned_at", T.TimestampType()),
        T.StructField("chat_id", T.LongType()),
        T.StructField("chat_identifier", T.StringType()),
        T.StructField("topic_id", T.LongType()),
        *RAW.fields,
    ]
)

CHECKPOINTS = T.StructType(
    [
        T.StructField("chat_identifier", T.StringType()),
        T.StructField("topic_id", T.LongType()),
        T.StructField("last_message_id", T.LongType()),
        T.StructField("last_run_ts", T.TimestampType()),
    ]
)
