"""Message tables derived from the given test tables.

The SQL runs in Spark and in DuckDB; `{events}` and `{documents}` stand for the
tables, `{ts}` for the name of the zone-less timestamp type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill import use_utc

MSGS = """
SELECT event_id AS id,
 CAST(1000 + length(event_type) AS BIGINT) AS chat_id,
 event_type AS chat_identifier,
 CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 4 END AS topic_id,
 event_id % 1000 AS message_id,
 ts AS date,
 CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 1 HOUR END AS edit_date,
 CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS sender_id,
 CASE WHEN user_id % 3 = 0 THEN 'user_' || CAST(user_id AS STRING) END AS sender_username,
 CASE WHEN event_id % 50 = 0 THEN ''
      WHEN event_id % 50 = 1 THEN '#' || event_type || ' #tag'
      WHEN event_id % 50 = 2 THEN '   ' || chr(10) || ' '
      WHEN event_id % 50 = 4 THEN NULL
      ELSE '  ' || event_type || '  ' || chr(13) || chr(10) || chr(10) || ' ' || props || ' ' END AS text,
 CASE WHEN event_id % 7 = 0 THEN event_id % 1000 - 1 END AS reply_to_msg_id,
 CASE WHEN event_id % 25 = 3 THEN 1 ELSE 0 END AS is_service,
 CASE WHEN event_id % 20 = 5 THEN 1 WHEN event_id % 20 = 6 THEN NULL ELSE 0 END AS deleted,
 ts AS updated_at,
 CAST(event_id % 3 AS INT) AS source_order,
 'chat_' || CAST(event_id % 3 AS STRING) AS source_name,
 '/sources/chat_' || CAST(event_id % 3 AS STRING) AS source_path
FROM {events}
"""

DOCS_MSGS = """
SELECT doc_id AS id, CAST(NULL AS BIGINT) AS chat_id, lang AS chat_identifier,
 CAST(-1 AS BIGINT) AS topic_id, doc_id AS message_id,
 {ts} '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS date,
 CAST(NULL AS {ts}) AS edit_date, CAST(NULL AS BIGINT) AS sender_id, source AS sender_username,
 text, CAST(NULL AS BIGINT) AS reply_to_msg_id, 0 AS is_service, 0 AS deleted,
 CAST(NULL AS {ts}) AS updated_at, CAST(3 + length(source) AS INT) AS source_order,
 source AS source_name, '/sources/' || source AS source_path
FROM {documents}
"""

# Both together: chats, and prose with many copies, as sources of one corpus.
CORPUS = f"SELECT * FROM ({MSGS}) AS m UNION ALL SELECT * FROM ({DOCS_MSGS}) AS d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("events", "documents") if "{" + n + "}" in sql}
    return spark.sql(sql.replace("{ts}", "TIMESTAMP_NTZ"), **tables)


def for_duckdb(sql: str) -> str:
    named = sql.replace("{ts}", "TIMESTAMP")
    return named.replace("{events}", "events").replace("{documents}", "documents")


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, MSGS)


def docs_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, DOCS_MSGS)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CORPUS)


def chronological_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages with ids that grow with time, as an increment needs them."""
    return msgs(spark, sf_dir).withColumn("message_id", F.col("id"))
