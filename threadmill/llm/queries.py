"""The registered queries of the subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.chats import conversation_digests, format_conversations
from threadmill.llm.decontaminate import contaminated
from threadmill.llm.jaccard import jaccard_groups
from threadmill.llm.language import fit_language, predict_language
from threadmill.llm.mixing import mix_sources
from threadmill.llm.phrases import collocations
from threadmill.llm.pieces import decode_pieces, encode_pieces
from threadmill.llm.quality import fit_quality, score_quality
from threadmill.llm.sharding import byte_shards
from threadmill.llm.structure import damaged, repair_report
from threadmill.llm.substrings import remove_repeated
from threadmill.llm.tokens import token_ids
from threadmill.llm.zipwarc import archived_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op5_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archived_pages(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op8_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    turns = F.array(F.lit("user"), F.lit("assistant"))
    more = spark.range(1).select(F.posexplode(turns).alias("turn", "role"))
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = more.select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", said.alias("text")
    )
    return conversation_digests(format_conversations(table.unionByName(extra)))


@_query
def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_table(spark, sf_dir, "documents"))


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit_language(docs.where(remainder != 2))
    marked = docs.select("doc_id", "text", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"))
    return predict_language(marked, model, carry=("doc_id", "held_out"))


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(_table(spark, sf_dir, "documents"))


@_query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"))


@_query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "first_word", "n_words")


@_query
def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_pieces(encode_pieces(_table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))


@_query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))
