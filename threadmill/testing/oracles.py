"""The queries in plain SQL, written for DuckDB and independently of the
operators where there is more than one way."""

from __future__ import annotations

from threadmill.testing import fixtures as fx
from threadmill.testing.queries import (
    CUTOFF,
    EDIT_CUTOFF,
    LAST_RUN,
    RATE_LIMIT,
    RATE_WINDOW,
    RETENTION_NOW,
    RUN_TS,
)

# --- fixed value: the white-space class, as in the text functions ------------------
WS = (
    r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# ---------------------------------------------------------------------------------

MSGS = fx.for_duckdb(fx.MSGS)
DOCS = fx.for_duckdb(fx.DOCS_MSGS)
CORPUS = fx.for_duckdb(fx.CORPUS)

EXPORT = (
    "chat_id, chat_identifier, topic_id, message_id, date, edit_date, sender_id, "
    "sender_username, text, reply_to_msg_id, is_service, deleted, updated_at"
)
ROW = "id, " + EXPORT
KEY = "chat_identifier, topic_id, message_id"

# The messages, keyed: no topic is -1.
KEYED = f"""msgs AS ({MSGS}),
keyed AS (SELECT * REPLACE (coalesce(topic_id, -1) AS topic_id) FROM msgs),
corpus AS ({CORPUS}),
keyed_corpus AS (SELECT * REPLACE (coalesce(topic_id, -1) AS topic_id) FROM corpus)"""


def norm(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '{WS}+', ' ', 'g'))"


def clean(text: str) -> str:
    unix = f"regexp_replace({text}, '\\r\\n?', chr(10), 'g')"
    tidy = f"lambda l: trim(regexp_replace(l, '{WS}+', ' ', 'g'))"
    lines = f"list_transform(string_split({unix}, chr(10)), {tidy})"
    return f"array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10))"


def iso(date: str) -> str:
    return (
        f"strftime({date}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({date}, '%f') = '000000' "
        f"THEN '' ELSE strftime({date}, '.%f') END || '+00:00'"
    )


def digest(text: str, mode: str, null_sender: str) -> str:
    sender = f"coalesce(nullif(sender_username, ''), CAST(sender_id AS VARCHAR), '{null_sender}')"
    day = "coalesce(strftime(date, '%Y-%m-%d'), '')"
    parts = {"text": [text], "text+sender": [text, sender], "text+sender+day": [text, sender, day]}
    return "sha256(" + " || chr(10) || ".join(parts[mode]) + ")"


def differs(a: str, b: str) -> str:
    """Whether the compared columns of two rows (prefixes) differ."""
    pairs = [
        ("edit_date", None),
        ("text", "''"),
        ("sender_id", "-1"),
        ("sender_username", "''"),
        ("reply_to_msg_id", "-1"),
        ("is_service", "0"),
    ]
    return " OR ".join(
        f"{a}{c} IS DISTINCT FROM {b}{c}"
        if d is None
        else f"coalesce({a}{c}, {d}) <> coalesce({b}{c}, {d})"
        for c, d in pairs
    )


def fold(source: str, keys: str = KEY) -> str:
    """CTEs `numbered` (all versions), `winner` (one row per key) over `source`,
    which has the message columns, `source_order` and the keys."""
    looked_back = ", ".join(
        f"lag({c}) OVER w AS before_{c}"
        for c in (
            "edit_date",
            "text",
            "sender_id",
            "sender_username",
            "reply_to_msg_id",
            "is_service",
            "deleted",
        )
    )
    return f"""looked AS (
 SELECT *, row_number() OVER w AS version_no, {looked_back},
  first_value(id) OVER w AS first_id, first_value(deleted) OVER w AS first_deleted,
  first_value(source_order) OVER w AS first_source
 FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY source_order, id)),
numbered AS (
 SELECT *, version_no = 1 OR (version_no = 2 AND coalesce(before_deleted, 0) <> 0)
  OR {differs("before_", "")} AS takes_effect FROM looked),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY version_no DESC) AS back,
  count(*) OVER (PARTITION BY {keys}) AS effects
 FROM numbered WHERE takes_effect),
winner AS (
 SELECT * REPLACE (first_id AS id, CASE WHEN version_no = 1 THEN deleted ELSE 0 END AS deleted)
 FROM ranked WHERE back = 1)"""


# Existing table and increment of the upsert queries.
UPSERT_INPUT = f"""{KEYED},
current_table AS (
 SELECT {ROW}, 0 AS source_order FROM keyed WHERE source_order = 0
 QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY id) = 1),
staged AS (SELECT {ROW}, date AS scanned FROM keyed WHERE source_order <> 0)"""


def upsert(staged_filter: str = "TRUE") -> str:
    return f"""WITH {UPSERT_INPUT},
increment AS (SELECT * FROM staged WHERE {staged_filter}),
versions AS (
 SELECT c.* FROM current_table AS c
 UNION ALL
 SELECT * EXCLUDE (scanned) REPLACE (0 AS deleted), 1 AS source_order FROM increment),
{fold("versions")},
state AS (
 SELECT {ROW}, CASE WHEN first_source = 1 THEN 'insert'
   WHEN coalesce(first_deleted, 0) <> 0 THEN 'revive'
   WHEN effects > 1 THEN 'update' ELSE 'unchanged' END AS change_type
 FROM winner),
touched AS (SELECT s.* FROM state AS s SEMI JOIN increment AS i USING ({KEY}))"""


# Known table, scanned keys and scopes of the deletion queries.
DELETION = f"""{KEYED},
known AS (
 SELECT {ROW} FROM keyed QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY id) = 1),
seen AS (SELECT DISTINCT {KEY} FROM keyed WHERE source_order <> 0),
gone AS (
 SELECT {ROW} FROM known AS k
 WHERE date >= TIMESTAMP '{LAST_RUN}' AND coalesce(deleted, 0) = 0 AND chat_identifier <> 'error'
  AND EXISTS (SELECT 1 FROM seen AS s
   WHERE s.chat_identifier = k.chat_identifier AND s.topic_id = k.topic_id)
  AND NOT EXISTS (SELECT 1 FROM seen AS s WHERE s.chat_identifier = k.chat_identifier
   AND s.topic_id = k.topic_id AND s.message_id = k.message_id))"""

# Messages with ids that grow with time, and what an earlier run left behind.
INCREMENT = f"""msgs AS (SELECT * REPLACE (id AS message_id) FROM ({MSGS})),
keyed AS (SELECT * REPLACE (coalesce(topic_id, -1) AS topic_id) FROM msgs),
checkpoints AS (
 SELECT chat_identifier, topic_id, max(message_id) AS last_message_id
 FROM keyed WHERE date < TIMESTAMP '{LAST_RUN}' AND chat_identifier <> 'view'
 GROUP BY chat_identifier, topic_id)"""

CSV_FIELDS = (
    f"chat_id, chat_identifier, topic_id, message_id, {iso('date')} AS date, "
    f"{iso('edit_date')} AS edit_date, sender_id, sender_username, text, reply_to_msg_id, "
    f"is_service, deleted, {iso('updated_at')} AS updated_at"
)


def jsonl_fields(text: str) -> str:
    return (
        f"chat_identifier AS chat, topic_id, message_id, {iso('date')} AS date, "
        f"{iso('edit_date')} AS edit_date, sender_id, sender_username, reply_to_msg_id, "
        f"coalesce(is_service, 0) <> 0 AS is_service, coalesce(deleted, 0) <> 0 AS deleted, "
        f"{text} AS text"
    )


VISIBLE = "coalesce(deleted, 0) = 0 AND coalesce(is_service, 0) = 0"
HAS_TEXT = "text IS NOT NULL AND text <> ''"
FIRST_SEEN = "ORDER BY date_trunc('second', date) NULLS FIRST, id"
IS_HASHTAGS = f"""(cleaned <> '' AND len(list_filter(regexp_split_to_array(cleaned, '{WS}+'),
 lambda t: NOT starts_with(t, '#'))) = 0)"""

IDENTIFIERS = r"""raws AS (
 SELECT page_id, CASE page_id % 5 WHEN 0 THEN '  ' || url || ' ' || chr(9) WHEN 1 THEN '@' || url
   WHEN 2 THEN '@name_' || CAST(page_id AS VARCHAR) ELSE url END AS raw,
  CASE WHEN page_id % 6 = 0 THEN CAST(123 AS BIGINT) END AS explicit
 FROM pages)"""


def parsed(identifier: str) -> str:
    return rf"""{IDENTIFIERS},
stripped AS (SELECT *, trim(raw, ' ' || chr(9)) AS plain FROM raws),
named AS (SELECT *, {identifier} AS name FROM stripped),
split AS (
 SELECT *, CASE WHEN starts_with(name, 'http://') OR starts_with(name, 'https://') THEN
   list_filter(string_split(regexp_replace(regexp_extract(name, '^https?://[^/?#]*([^?#]*)', 1),
    ';[^/]*$', ''), '/'), lambda p: p <> '') END AS parts
 FROM named),
found AS (
 SELECT page_id, explicit, CASE WHEN len(parts) > 0 THEN parts[1] ELSE name END AS chat,
  CASE WHEN len(parts) > 1 AND regexp_full_match(parts[2], '[+-]?[0-9]+')
   THEN TRY_CAST(parts[2] AS BIGINT) END AS topic
 FROM split)"""


def safe(name: str) -> str:
    plain = f"regexp_replace(trim({name}, ' ' || chr(9)), '[^A-Za-z0-9._-]+', '_', 'g')"
    return f"coalesce(nullif(trim(regexp_replace({plain}, '_+', '_', 'g'), '._-'), ''), 'export')"


def posts(mode: str, name: str = "posts", extra: str = "coalesce(deleted, 0) = 0") -> str:
    return f"""{name} AS (
 SELECT dedupe_hash, text, date AS first_date,
  CASE WHEN date IS NOT NULL THEN latest END AS last_date, sender_id, sender_username
 FROM (
  SELECT *, max(date) OVER (PARTITION BY dedupe_hash) AS latest,
   row_number() OVER (PARTITION BY dedupe_hash ORDER BY source_order, id) AS arrival
  FROM (SELECT * REPLACE (normal AS text), {digest("normal", mode, "")} AS dedupe_hash
   FROM (SELECT *, {norm("text")} AS normal FROM corpus) WHERE normal <> '' AND {extra}))
 WHERE arrival = 1)"""


ORACLES: dict[str, str] = {}

# --- scans ------------------------------------------------------------------------

ORACLES["raw_flatten"] = f"""WITH {KEYED}
SELECT chat_id, chat_identifier, topic_id, message_id, date, edit_date, sender_id, sender_username,
 text, reply_to_msg_id, is_service, 0 AS deleted, TIMESTAMP '{RUN_TS}' AS updated_at
FROM keyed WHERE text IS NOT NULL"""

ORACLES["scan_project"] = f"WITH msgs AS ({MSGS}) SELECT {EXPORT} FROM msgs"

ORACLES["tolerant_scan"] = f"""WITH msgs AS ({MSGS})
SELECT chat_identifier, CAST(-1 AS BIGINT) AS topic_id, message_id, date, sender_id,
 CAST(NULL AS VARCHAR) AS sender_username, text, 0 AS deleted FROM msgs"""

ORACLES["multi_source_scan"] = f"""WITH {KEYED}
SELECT {ROW}, 0 AS source_order, 'chats' AS source_name, '/sources/chats' AS source_path FROM keyed
UNION ALL
SELECT * EXCLUDE (source_order, source_name, source_path)
 REPLACE (CAST(-1 AS BIGINT) AS topic_id, 0 AS deleted),
 1, 'old_chats', '/sources/old' FROM keyed
UNION ALL
SELECT {ROW}, 2, 'prose', '/sources/prose' FROM ({DOCS})"""

ORACLES["source_catalog"] = """SELECT DISTINCT source_name FROM (
 SELECT source || CASE lang WHEN 'fr' THEN '_Backup.db' WHEN 'es' THEN '_archive.db' ELSE '.db' END
  AS source_name FROM documents)
WHERE lower(source_name) NOT LIKE '%backup%' AND lower(source_name) NOT LIKE '%archive%'"""

ORACLES["incremental_scan"] = f"""WITH {INCREMENT}
SELECT m.* FROM keyed AS m LEFT JOIN checkpoints AS c USING (chat_identifier, topic_id)
WHERE m.message_id > coalesce(c.last_message_id, 0) AND m.date >= TIMESTAMP '{CUTOFF}'"""

ORACLES["full_history_scan"] = f"""WITH {INCREMENT}
SELECT {ROW.replace("deleted", "0 AS deleted")} FROM keyed"""

ORACLES["thread_scope"] = f"WITH msgs AS ({MSGS}) SELECT * FROM msgs WHERE reply_to_msg_id = 20"

# --- exports ----------------------------------------------------------------------

ORACLES["csv_export"] = f"WITH corpus AS ({CORPUS}) SELECT {CSV_FIELDS} FROM corpus"

ORACLES["jsonl_export"] = f"""WITH corpus AS ({CORPUS})
SELECT {jsonl_fields(clean("text"))} FROM corpus WHERE {VISIBLE} AND {HAS_TEXT}"""

ORACLES["jsonl_written"] = ORACLES["jsonl_export"]

ORACLES["csv_written"] = f"""WITH corpus AS ({CORPUS}), fields AS (SELECT {CSV_FIELDS} FROM corpus)
SELECT nullif(CAST(COLUMNS(*) AS VARCHAR), '') FROM fields"""
ORACLES["csv_appended"] = ORACLES["csv_written"]

ORACLES["jsonl_export_filtered"] = f"""WITH corpus AS ({CORPUS}),
cleaned AS (SELECT *, {clean("text")} AS cleaned FROM corpus WHERE {HAS_TEXT}),
kept AS (SELECT * FROM cleaned WHERE length(cleaned) >= 3 AND NOT {IS_HASHTAGS})
SELECT {jsonl_fields("cleaned")} FROM kept
QUALIFY row_number() OVER (PARTITION BY cleaned {FIRST_SEEN}, chat_identifier, topic_id NULLS FIRST,
 message_id) = 1"""

ORACLES["upsert_snapshot"] = f"{upsert()} SELECT {ROW} FROM state"
ORACLES["snapshot_write"] = ORACLES["upsert_snapshot"]
ORACLES["store_fold"] = ORACLES["upsert_snapshot"]
ORACLES["upsert_changes"] = f"{upsert()} SELECT {ROW}, change_type FROM touched"
_young = f"scanned >= TIMESTAMP '{EDIT_CUTOFF}'"
ORACLES["edit_rescan"] = f"{upsert(_young)} SELECT {ROW}, change_type FROM touched"

# --- scalar functions -------------------------------------------------------------

ORACLES["normalize_text"] = f"""WITH corpus AS ({CORPUS})
SELECT source_name, id, {norm("text")} AS normal FROM corpus"""

ORACLES["clean_text"] = f"""WITH corpus AS ({CORPUS})
SELECT source_name, id, {clean("text")} AS cleaned FROM corpus"""

for _name, _mode, _null in (
    ("dedupe_hash_text", "text", ""),
    ("dedupe_hash_sender", "text+sender", ""),
    ("dedupe_hash_sender_day", "text+sender+day", "None"),
):
    ORACLES[_name] = f"""WITH corpus AS ({CORPUS})
SELECT source_name, id, {digest(norm("text"), _mode, _null)} AS dedupe_hash FROM corpus"""

ORACLES["parse_chat"] = f"""WITH {parsed("plain")}
SELECT page_id, chat, coalesce(explicit, topic) AS topic FROM found"""

ORACLES["parse_chat_export"] = f"""WITH {parsed("regexp_replace(plain, '^@', '')")}
SELECT page_id, chat, topic FROM found"""

ORACLES["topic_norm"] = f"WITH msgs AS ({MSGS}) SELECT id, coalesce(topic_id, -1) AS topic_id FROM msgs"

ORACLES["safe_name"] = f"""WITH {IDENTIFIERS}
SELECT page_id, {safe("raw")} AS safe, regexp_replace(raw, '[^A-Za-z0-9._-]+', '_', 'g') AS merged,
 {safe("raw")} || CASE WHEN explicit IS NULL THEN '' ELSE '_' || CAST(explicit AS VARCHAR) END AS base
FROM raws"""

ORACLES["utc_order_key"] = """SELECT event_id, CASE event_id % 4
  WHEN 0 THEN date_trunc('second', ts)
  WHEN 1 THEN date_trunc('second', ts) - INTERVAL 3 HOUR
  WHEN 2 THEN date_trunc('second', ts) + INTERVAL 330 MINUTE END AS order_key
FROM events"""

ORACLES["iso_render"] = f"""WITH msgs AS ({MSGS})
SELECT id, {iso("date")} AS date, {iso("edit_date")} AS edit_date FROM msgs"""

# --- predicates -------------------------------------------------------------------

ORACLES["filter_chat_topic"] = f"""WITH msgs AS ({MSGS})
SELECT {EXPORT} FROM msgs WHERE (chat_identifier = 'click' AND coalesce(topic_id, -1) = -1)
 OR (chat_identifier = 'view' AND coalesce(topic_id, -1) = 2)"""

ORACLES["filter_flags"] = f"WITH msgs AS ({MSGS}) SELECT * FROM msgs WHERE {VISIBLE}"

ORACLES["filter_text"] = f"""WITH corpus AS ({CORPUS})
SELECT source_name, id, {norm("text")} <> '' AS has_words FROM corpus WHERE {HAS_TEXT}"""

ORACLES["min_chars"] = f"""WITH corpus AS ({CORPUS}),
cleaned AS (SELECT *, {clean("text")} AS cleaned FROM corpus)
SELECT source_name, id, length(cleaned) AS chars FROM cleaned WHERE length(cleaned) >= 20"""

ORACLES["hashtag_only"] = f"""WITH corpus AS ({CORPUS}),
cleaned AS (SELECT *, {clean("text")} AS cleaned FROM corpus WHERE {HAS_TEXT})
SELECT source_name, id, {IS_HASHTAGS} AS hashtag_only FROM cleaned"""

ORACLES["recent_window"] = f"""WITH msgs AS ({MSGS})
SELECT {EXPORT} FROM msgs WHERE date >= TIMESTAMP '{EDIT_CUTOFF}'"""

ORACLES["change_predicate"] = f"""WITH {UPSERT_INPUT},
later AS (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY id) = 1)
SELECT o.chat_identifier, o.topic_id, o.message_id,
 ({differs("o.", "n.")} OR coalesce(o.deleted, 0) <> 0) AS changed
FROM current_table AS o JOIN later AS n ON o.chat_identifier = n.chat_identifier
 AND o.topic_id = n.topic_id AND o.message_id = n.message_id"""

# --- upserts ----------------------------------------------------------------------

ORACLES["new_keys"] = f"""WITH {UPSERT_INPUT}
SELECT id, {KEY} FROM staged ANTI JOIN current_table USING ({KEY})"""

ORACLES["known_keys"] = f"""WITH {UPSERT_INPUT}
SELECT id, {KEY} FROM staged SEMI JOIN current_table USING ({KEY})"""

ORACLES["merge_sources"] = f"""WITH {KEYED}, {fold("keyed_corpus")} SELECT {ROW} FROM winner"""
ORACLES["merge_sources_split"] = ORACLES["merge_sources"]

ORACLES["merge_counters"] = f"""WITH {KEYED}, {fold("keyed_corpus")}
SELECT count(*) AS processed, count(*) FILTER (version_no = 1) AS inserted,
 count(*) FILTER (takes_effect AND version_no > 1) AS updated,
 count(*) FILTER (NOT takes_effect) AS skipped
FROM numbered"""

ORACLES["version_history"] = f"""WITH {KEYED}, {fold("keyed_corpus")}
SELECT {KEY}, source_order, id, version_no, takes_effect FROM numbered"""
ORACLES["version_history_split"] = ORACLES["version_history"]

GROUPS = """first_chats AS (
 SELECT source_name, chat_identifier FROM corpus
 QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY id) = 1),
groups AS (
 SELECT chat_identifier, source_name, count(*) OVER (PARTITION BY chat_identifier) AS source_count
 FROM first_chats)"""

ORACLES["merge_groups"] = f"""WITH {KEYED}, {GROUPS}
SELECT chat_identifier, source_name, source_count FROM groups WHERE source_count >= 2"""

ORACLES["merge_chats"] = f"""WITH {KEYED}, {GROUPS},
grouped AS (
 SELECT c.*, g.chat_identifier AS merged_into FROM keyed_corpus AS c
 JOIN groups AS g ON c.source_name = g.source_name WHERE g.source_count >= 2),
{fold("grouped", "merged_into, " + KEY)}
SELECT merged_into, {ROW} FROM winner"""

ORACLES["seen_ids"] = f"WITH {DELETION} SELECT {KEY} FROM seen"

ORACLES["mark_deleted"] = f"""WITH {DELETION}
SELECT k.* REPLACE (CASE WHEN g.id IS NULL THEN k.deleted ELSE 1 END AS deleted,
 CASE WHEN g.id IS NULL THEN k.updated_at ELSE TIMESTAMP '{RUN_TS}' END AS updated_at)
FROM known AS k LEFT JOIN gone AS g ON k.id = g.id"""

ORACLES["change_summary"] = f"""WITH changes AS ({upsert()} SELECT change_type FROM touched
 UNION ALL SELECT 'delete' FROM (WITH {DELETION} SELECT * FROM gone)),
counts AS (
 SELECT count(*) FILTER (change_type = 'insert') AS inserted,
  count(*) FILTER (change_type = 'update') AS updated,
  count(*) FILTER (change_type = 'revive') AS revived,
  count(*) FILTER (change_type = 'delete') AS deleted,
  count(*) FILTER (change_type = 'unchanged') AS unchanged FROM changes)
SELECT *, inserted + updated + revived + deleted > 0 AS export_needed FROM counts"""

ORACLES["checkpoint_update"] = f"""WITH {INCREMENT},
scopes AS (SELECT DISTINCT chat_identifier, topic_id FROM keyed),
seen AS (
 SELECT chat_identifier, topic_id, max(message_id) AS highest FROM keyed
 WHERE date >= TIMESTAMP '{EDIT_CUTOFF}' GROUP BY chat_identifier, topic_id)
SELECT s.chat_identifier, s.topic_id,
 greatest(coalesce(last_message_id, 0),
  CASE WHEN s.chat_identifier <> 'error' THEN coalesce(highest, 0) ELSE 0 END) AS last_message_id,
 CASE WHEN s.chat_identifier <> 'error' THEN TIMESTAMP '{RUN_TS}' ELSE TIMESTAMP '{LAST_RUN}' END
  AS last_run_ts
FROM scopes AS s LEFT JOIN checkpoints AS c USING (chat_identifier, topic_id)
 LEFT JOIN seen AS n USING (chat_identifier, topic_id)"""

ORACLES["dedupe_min_id"] = f"WITH {DELETION} SELECT * FROM known"

SYNC = f"""{INCREMENT},
known AS (SELECT * FROM keyed WHERE source_order <> 2),
scanned AS (SELECT * FROM keyed WHERE source_order <> 1 AND date >= TIMESTAMP '{CUTOFF}'),
gone AS (
 SELECT k.* FROM known AS k ANTI JOIN scanned AS s USING ({KEY})
 WHERE date >= TIMESTAMP '{CUTOFF}' AND coalesce(deleted, 0) = 0 AND chat_identifier <> 'error'),
inserted AS (SELECT s.* FROM scanned AS s ANTI JOIN known AS k USING ({KEY})),
revived AS (
 SELECT s.* FROM scanned AS s
 SEMI JOIN (SELECT * FROM known WHERE coalesce(deleted, 0) <> 0) AS k USING ({KEY}))"""

ORACLES["sync_summary"] = f"""WITH {SYNC},
counts AS (
 SELECT (SELECT count(*) FROM inserted) AS inserted, CAST(0 AS BIGINT) AS updated,
  (SELECT count(*) FROM revived) AS revived, (SELECT count(*) FROM gone) AS deleted,
  (SELECT count(*) FROM scanned AS s
    SEMI JOIN (SELECT * FROM known WHERE coalesce(deleted, 0) = 0) AS k USING ({KEY})) AS unchanged)
SELECT *, inserted + updated + revived + deleted > 0 AS export_needed FROM counts"""

ORACLES["sync_snapshot"] = f"""WITH {SYNC},
changed AS (
 SELECT * REPLACE (0 AS deleted) FROM inserted UNION ALL SELECT * REPLACE (0 AS deleted) FROM revived
 UNION ALL SELECT * REPLACE (1 AS deleted, TIMESTAMP '{RUN_TS}' AS updated_at) FROM gone)
SELECT {ROW} FROM changed
UNION ALL SELECT {ROW} FROM known ANTI JOIN changed USING ({KEY})"""

# --- aggregates -------------------------------------------------------------------

ORACLES["table_stats"] = f"""WITH msgs AS ({MSGS})
SELECT count(*) AS count, min(date) AS earliest, max(date) AS latest FROM msgs"""

ORACLES["stats_chats"] = f"""WITH msgs AS ({MSGS})
SELECT DISTINCT chat_identifier, topic_id FROM msgs
ORDER BY chat_identifier, topic_id NULLS FIRST LIMIT 10"""

ORACLES["chat_profile"] = f"""WITH msgs AS ({MSGS})
SELECT chat_identifier, max(message_id) AS latest_message_id,
 strftime(min(date), '%Y-%m') AS earliest_month FROM msgs GROUP BY chat_identifier"""

for _mode in ("text", "text+sender", "text+sender+day"):
    _suffix = _mode.replace("+", "_")
    _tie = "chat_identifier, topic_id NULLS FIRST, message_id"
    ORACLES[f"dedupe_csv_{_suffix}"] = f"""WITH corpus AS ({CORPUS})
SELECT {EXPORT} FROM corpus
QUALIFY row_number() OVER (PARTITION BY {digest(norm("text"), _mode, "None")} {FIRST_SEEN}, {_tie}) = 1"""
    ORACLES[f"dedupe_jsonl_{_suffix}"] = f"""WITH corpus AS ({CORPUS}),
cleaned AS (
 SELECT * REPLACE ({clean("text")} AS text) FROM corpus WHERE {VISIBLE} AND {HAS_TEXT})
SELECT {EXPORT} FROM cleaned
QUALIFY row_number() OVER (PARTITION BY {digest("text", _mode, "None")} {FIRST_SEEN}, {_tie}) = 1"""
    ORACLES[f"agg_posts_{_suffix}"] = f"WITH corpus AS ({CORPUS}), {posts(_mode)} SELECT * FROM posts"

ORACLES["agg_post_sources"] = f"""WITH corpus AS ({CORPUS}),
kept AS (
 SELECT sha256({norm("text")}) AS post_id, source_name, chat_identifier,
  coalesce(topic_id, -1) AS topic_id, CASE WHEN reply_to_msg_id IS NULL THEN message_id END AS message_id,
  date, source_order, id
 FROM corpus WHERE coalesce(deleted, 0) = 0 AND {norm("text")} <> '')
SELECT post_id, source_name, chat_identifier, topic_id, message_id, date FROM kept
WHERE message_id IS NULL
UNION ALL
SELECT post_id, source_name, chat_identifier, topic_id, message_id, date FROM (
 SELECT * FROM kept WHERE message_id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY post_id, source_name, chat_identifier, topic_id, message_id
  ORDER BY source_order, id) = 1)"""

ORACLES["agg_sources"] = f"""WITH corpus AS ({CORPUS})
SELECT source_name, source_path FROM corpus
QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY source_order, id) = 1"""

ORACLES["agg_sources_listed"] = ORACLES["agg_sources"]

ORACLES["agg_shared"] = f"""WITH corpus AS ({CORPUS}), {posts("text+sender")},
places AS (SELECT dedupe_hash, count(*) AS places FROM (
 SELECT DISTINCT {digest(norm("text"), "text+sender", "")} AS dedupe_hash, source_name, chat_identifier,
  coalesce(topic_id, -1) AS topic_id, message_id
 FROM corpus WHERE coalesce(deleted, 0) = 0 AND {norm("text")} <> '') GROUP BY dedupe_hash)
SELECT * FROM posts JOIN places USING (dedupe_hash)"""

ORACLES["agg_counters"] = f"""WITH corpus AS ({CORPUS}),
flagged AS (SELECT coalesce(deleted, 0) = 0 AND {norm("text")} <> '' AS kept, {norm("text")} AS normal
 FROM corpus)
SELECT count(*) AS rows_read, count(*) FILTER (kept) AS rows_kept,
 count(DISTINCT normal) FILTER (kept) AS unique_posts FROM flagged"""

# --- streams and rates ------------------------------------------------------------

ORACLES["sync_store_run"] = ORACLES["sync_snapshot"]

ORACLES["stream_counters"] = """
WITH landed AS (
    SELECT DISTINCT event_id % 4 AS slice, event_type, coalesce(user_id % 4, 0) AS topic, event_id % 1000 AS message_id
    FROM events WHERE ts IS NOT NULL
)
SELECT 'stream' AS writer, 4::BIGINT AS batches,
    (SELECT count(*) FROM (SELECT DISTINCT event_type, topic, message_id FROM landed)) AS inserted,
    (SELECT count(*) FROM landed) AS touched
"""

ORACLES["stream_upsert"] = f"""WITH {KEYED},
streamed AS (
 SELECT * REPLACE (0 AS deleted, 0 AS source_order, coalesce(text, '') AS text) FROM keyed),
{fold("streamed")}
SELECT {EXPORT} FROM winner"""

ORACLES["rate_offered"] = f"""SELECT event_id, user_id, ts, count(*) OVER (
  PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN {RATE_WINDOW * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS offered
FROM events"""

# The rule step by step: one event per key and step, with the admitted times so far.
ORACLES["rate_admitted"] = f"""WITH RECURSIVE ordered AS (
 SELECT event_id, user_id, ts, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
step AS (
 SELECT event_id, user_id, ts, n, TRUE AS admitted, [t] AS recent FROM ordered WHERE n = 1
 UNION ALL
 SELECT o.event_id, o.user_id, o.ts, o.n,
  len(list_filter(s.recent, lambda x: o.t - x < {RATE_WINDOW * 1_000_000})) < {RATE_LIMIT},
  CASE WHEN len(list_filter(s.recent, lambda x: o.t - x < {RATE_WINDOW * 1_000_000})) < {RATE_LIMIT}
   THEN list_append(list_filter(s.recent, lambda x: o.t - x < {RATE_WINDOW * 1_000_000}), o.t)
   ELSE list_filter(s.recent, lambda x: o.t - x < {RATE_WINDOW * 1_000_000}) END
 FROM step AS s JOIN ordered AS o ON o.user_id = s.user_id AND o.n = s.n + 1)
SELECT event_id, user_id, ts, admitted FROM step"""

ORACLES["stream_rate"] = f"""WITH admitted AS ({ORACLES["rate_admitted"]})
SELECT user_id, event_id, admitted FROM admitted"""

ORACLES["rate_exempt"] = """SELECT event_id, '/' || event_type AS path FROM events
WHERE event_type NOT IN ('view', 'error')"""

# --- quality, evolution, retention ------------------------------------------------

ORACLES["dq_not_null"] = f"""WITH msgs AS ({MSGS})
SELECT count(*) FILTER (chat_identifier IS NULL) AS null_chat_identifier,
 count(*) FILTER (topic_id IS NULL) AS null_topic_id,
 count(*) FILTER (message_id IS NULL) AS null_message_id,
 count(*) FILTER (date IS NULL) AS null_date FROM msgs"""

ORACLES["dq_unique"] = f"""WITH {KEYED}
SELECT {KEY}, count(*) AS copies FROM keyed GROUP BY {KEY} HAVING count(*) > 1"""

ORACLES["dq_foreign_keys"] = f"""WITH corpus AS ({CORPUS}), {posts("text")},
places AS (
 SELECT sha256({norm("text")}) AS post_id, source_name FROM corpus WHERE {norm("text")} <> ''
 GROUP BY post_id, source_name, chat_identifier, coalesce(topic_id, -1), message_id)
SELECT 'post_id' AS reference, post_id AS value, count(*) AS rows FROM places
WHERE post_id NOT IN (SELECT dedupe_hash FROM posts) GROUP BY post_id
UNION ALL
SELECT 'source_name', source_name, count(*) FROM places WHERE source_name = 'chat_1' GROUP BY source_name"""

ORACLES["health_report"] = f"""WITH {KEYED},
duplicates AS (
 SELECT source_name, count(*) AS duplicate_keys FROM (
  SELECT source_name FROM keyed_corpus GROUP BY source_name, {KEY} HAVING count(*) > 1)
 GROUP BY source_name),
report AS (
 SELECT source_name, count(*) AS message_count, min(date) AS earliest_date, max(date) AS latest_date,
  count(*) FILTER (chat_identifier IS NULL OR message_id IS NULL OR date IS NULL) AS incomplete_rows
 FROM keyed_corpus GROUP BY source_name)
SELECT r.*, coalesce(d.duplicate_keys, 0) AS duplicate_keys,
 CASE WHEN incomplete_rows = 0 AND coalesce(d.duplicate_keys, 0) = 0 THEN 'healthy' ELSE 'warning' END
  AS status
FROM report AS r LEFT JOIN duplicates AS d USING (source_name)"""

ORACLES["health_report_listed"] = f"""WITH whole AS ({ORACLES["health_report"]}),
rows AS (SELECT * FROM whole WHERE source_name <> 'chat_1')
SELECT * FROM rows UNION ALL SELECT 'chat_1', 0, NULL, NULL, 0, 0, 'healthy'"""

ORACLES["schema_upgrade"] = f"""WITH {KEYED}
SELECT * EXCLUDE (source_order, source_name, source_path) REPLACE (CAST(NULL AS TIMESTAMP) AS edit_date,
 0 AS deleted, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS BIGINT) AS chat_id) FROM keyed"""

ORACLES["schema_status"] = """WITH versions AS (
 SELECT * FROM (VALUES (1, 'add_topic_id_column'), (2, 'add_edit_date_column'),
  (3, 'add_deleted_column'), (4, 'add_updated_at_column')) AS v(version, name)),
tables AS (
 SELECT 'table_' || CAST(user_id AS VARCHAR) AS table_name, coalesce(max(CASE
  WHEN event_id % 5 > 0 AND event_id % 5 <= user_id % 5 THEN event_id % 5 END), 0) AS current_version
 FROM events GROUP BY user_id)
SELECT table_name, current_version, CAST(4 AS BIGINT) AS latest_version,
 count(version) AS pending_count,
 coalesce(string_agg(name, ',' ORDER BY version), '') AS pending, current_version >= 4 AS up_to_date
FROM tables LEFT JOIN versions ON version > current_version GROUP BY table_name, current_version"""

ORACLES["retention_expired"] = f"""WITH artifacts AS (
 SELECT 'chat' || CAST(event_id AS VARCHAR) || CASE event_id % 3
   WHEN 0 THEN '_' || strftime(ts - INTERVAL 80 DAY, '%Y%m%d_%H%M%S')
   WHEN 1 THEN '_20231399_250000' ELSE '' END || '.db' AS name,
  CASE event_type WHEN 'signup' THEN 'temp' WHEN 'error' THEN 'logs' WHEN 'click' THEN 'backups'
   WHEN 'view' THEN 'archives' ELSE 'kept' END AS kind, ts AS mtime,
  event_id % 3 AS stamp
 FROM events),
dated AS (
 SELECT name, kind, mtime, CASE WHEN kind <> 'archives' THEN mtime
   WHEN stamp = 0 THEN date_trunc('second', mtime - INTERVAL 80 DAY)
   WHEN stamp = 2 THEN mtime END AS dated,
  CASE kind WHEN 'temp' THEN 7 WHEN 'logs' THEN 30 WHEN 'backups' THEN 30 WHEN 'archives' THEN 90 END
   AS days
 FROM artifacts)
SELECT name, kind, mtime, dated FROM dated
WHERE dated < TIMESTAMP '{RETENTION_NOW}' - days * INTERVAL 1 DAY"""
