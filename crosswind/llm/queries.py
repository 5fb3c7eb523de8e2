"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.llm import chat, decontam, linededup, passages, pieces, private, quality, scoring, sharding, simhash
from crosswind.llm.common import table
from crosswind.llm.oracles import CHAT_SQL, HITS_SQL, LINES_SQL, QUALITY_SQL


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.document_shards(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_verdicts(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.conversation_digests(chat.render_turns(turns.unionByName(more)))


def op1_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.document_passages(table(spark, sf_dir, "documents"))


def op9_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.document_spans(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_groups(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.document_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_scoring": op1_scoring, "op3_lines": op3_lines, "op4_decontamination": op4_decontamination, "op2_pieces": op2_pieces, "op5_passages": op5_passages, "op9_private": op9_private, "op10_simhash": op10_simhash, "op6_sharding": op6_sharding, "op7_quality": op7_quality, "op8_chat": op8_chat}
ORACLE_SQL = {"op3_lines": LINES_SQL, "op4_decontamination": HITS_SQL, "op7_quality": QUALITY_SQL, "op8_chat": CHAT_SQL}
