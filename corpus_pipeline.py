"""The corpus pipeline: from documents to a training mix, one table after each stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents. run() writes every result as
Parquet in the shared folder and reads it again as the next stage's docs.

Null, empty, repeated: null texts count as empty ones: the classifier may reject
them, near_dedup keeps them but for repeats of a row, the others leave them alone
(the mix takes no words from them, so they end there); rows without an id, or with
the same one, are told apart by their texts; an empty table gives an empty result.
Columns of documents that are named like an operator's own are handed on as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import decontam, mixing, near_dup, quality, suffix_dedup
from vecloom.llm.queries import table
from vecloom.llm.runtime import compact, release, scan_tasks, stored, written


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names called otherwise, and what gives a result of the stage the columns of docs again."""
    moved = {}
    for c in docs.columns:
        if c in names:
            moved[c] = f"_own_{c}"
            while moved[c] in docs.columns:
                moved[c] = f"_{moved[c]}"
    back = lambda df: df.select(*[F.col(moved.get(c, c)).alias(c) for c in docs.columns])
    return docs.withColumnsRenamed(moved), back


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    docs, back = _aside(docs, "score", "predicted", "_stats")
    return back(quality.score(docs, model).where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    docs, back = _aside(docs, "_d", "_t", "_n")
    return back(near_dup.keep_one(docs))


def suffix_dedup_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what they share with others or repeat, in strings of 200 bytes; documents that are nothing else go."""
    docs, back = _aside(docs, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "_d", "_t", "_spans")
    out = suffix_dedup.remove_repeats(docs, as_text=True).where((F.col("n_removed") == 0) | (F.length(F.trim("kept")) > 0))
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return back(out.withColumns({c: x for c, x in new.items() if c in docs.columns}))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    docs, back = _aside(docs, "_key")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))
    keyed = docs.withColumn("_key", key)
    hit = decontam.match(keyed, table(spark, sf_dir, "benchmark"), id_col="_key").where("n_hit > 0").select(F.col("doc").alias("_key")).distinct()
    return compact(back(keyed.join(hit, "_key", "left_anti")), scan_tasks(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, with size, source_size, target and taken (words, repeats counted)."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup_text), ("decontaminate", decontaminate), ("mix", mix_sources)]

#: Fitted models and byte-wise cuts are beyond SQL: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = written()
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, mark, "pipeline-")  # the stage's own tables; its result stays
    return docs
