"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import (exchange, graph, langid, lm, mixing, packing, quality, repair, signatures, simhash, spans,
                        topk, toxicity)
from adlens.llm.oracle import ORACLE
from adlens.llm.tables import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _held_out(m: int, remainder: int):
    """Rows that nothing is learned from: of this remainder, or without an id."""
    return F.coalesce(crc_mod("doc_id", m) == remainder, F.lit(True)).alias("held_out")


def q_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without sentences that repeat from an earlier place."""
    return spans.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def q_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def q_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", _held_out(5, 0), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def q_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return quality.score(docs, model).select(
        "doc_id", _held_out(4, 2), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simhash.classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def q_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return scored.withColumn("held_out", _held_out(5, 1))


def q_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod("doc_id", 5) != 0))
    return langid.predict(docs, model).select(
        "doc_id", _held_out(5, 0), "lang_pred", "score")


def q_golomb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.classes(table(spark, sf_dir, "documents")) \
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def q_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def q_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair(conversations, repair.damage(conversations))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": q_substring_dedup,
    "op2_source_mix": q_source_mix,
    "op3_packing": q_packing,
    "op4_ann": q_ann,
    "op5_toxicity": q_toxicity,
    "op6_exact_topk": q_exact_topk,
    "op8_quality": q_quality,
    "op7_simhash": q_simhash,
    "op9_lm_score": q_lm_score,
    "op10_langid": q_langid,
    "op11_golomb_dedup": q_golomb_dedup,
    "op12_lexical_search": q_lexical_search,
    "op13_conversation_repair": q_conversation_repair,
}

__all__ = ["ORACLE", "QUERIES", "vocabulary"]
