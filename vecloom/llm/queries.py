"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, mixing, near_dup, ppm, quality, suffix_dedup, topk, warc
from .runtime import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs, where=~held)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    return ppm.score(docs.select("doc_id", held.alias("held_out"), "text"), ~F.col("held_out"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.messages_in_order(chat.conversations(chat.link(table(spark, sf_dir, "conversations"))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, where=crc_mod("doc_id", 5) != 0)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op1_near_duplicates": op1_near_duplicates, "op2_top_k": op2_top_k, "op3_suffix_dedup": op3_suffix_dedup, "op4_language_id": op4_language_id, "op5_mix_sources": op5_mix_sources, "op6_ppm_score": op6_ppm_score, "op7_warc": op7_warc, "op8_decontaminate": op8_decontaminate, "op9_chat": op9_chat, "op10_quality": op10_quality}
ORACLES = {"op2_top_k": topk.ORACLE, "op5_mix_sources": mixing.ORACLE, "op7_warc": warc.ORACLE, "op8_decontaminate": decontam.ORACLE, "op9_chat": chat.ORACLE}
