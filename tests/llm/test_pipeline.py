"""run() against a brute-force version, stage by stage on what the stage before kept."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline as cp
from vecloom.llm import quality

from . import brute

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in table.collect() if brute.quality(r["text"], model) >= 0.3}
    docs = [r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist() if r["doc_id"] in good]
    assert 0 < len(docs) < table.count()

    group = brute.components([(r["doc_id"], r["text"]) for r in docs])
    docs = [r for r in docs if group[r["doc_id"]][1] == r["doc_id"]]
    cut = brute.without_repeats([r["text"] for r in docs])
    assert any(n for _, n, _ in cut)
    docs = [{**r, "text": k.decode("utf-8", "ignore")} if n else r for r, (k, n, _) in zip(docs, cut, strict=True) if not n or k.decode("utf-8", "ignore").strip(" ")]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    docs = [r for r in docs if not brute.hits(r["text"], items)[1]]
    taken = brute.mix([(r["doc_id"], r["source"], r["text"]) for r in docs])

    got = {r["doc_id"]: (r["text"], r["taken"]) for r in cp.run(spark, SF).collect()}
    assert got == {r["doc_id"]: (r["text"], taken[r["doc_id"]]) for r in docs if taken[r["doc_id"]]}


def test_stages_hand_on_columns_with_clashing_names(spark):
    """Columns named like those of an operator keep their values; nulls, empty and repeated rows pass."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    docs = docs.unionByName(docs.limit(2)).unionByName(docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars"))
    names = ["_key", "score", "predicted", "kept", "n_removed", "_d", "_n", "_own__key"]
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in names])
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in names)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
    empty = docs.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
