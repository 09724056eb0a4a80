"""Centroid, medoids, leaf and graph statistics, recall and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import squared_l2


def centroid(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, centroid): mean vector in double, in order of the axes."""
    flat = vectors.select(*keys, F.posexplode("vec").alias("axis", "x"))
    means = flat.groupBy(*keys, "axis").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda s: s["m"])  # one entry for each axis
    return means.groupBy(*keys).agg(lists.alias("centroid"))


def medoid(vectors: DataFrame, eligible: Column | None = None) -> DataFrame:
    """(id, d2) nearest to the mean of all rows, ties by id; eligible: rows that may be picked."""
    mean = centroid(vectors)
    rows = vectors if eligible is None else vectors.where(eligible)
    return rows.crossJoin(F.broadcast(mean)).select("id", squared_l2("vec", "centroid").alias("d2")).orderBy("d2", "id").limit(1)  # the mean is one row


def finite(vec: str = "vec") -> Column:
    return ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def sampled_medoid(vectors: DataFrame, total: int, samples: int = 8192) -> DataFrame:
    """medoid() where only every ceil(total / samples)-th id may be picked; rows that aren't finite are left out."""
    stride = max(1, -(-total // samples))
    return medoid(vectors.where(finite()), F.col("id") % stride == 0)


def overlap_ratio(members: DataFrame) -> DataFrame:
    return members.agg(F.count(F.lit(1)).alias("places"), F.countDistinct("id").alias("points")).withColumn("ratio", F.col("places") / F.col("points"))


#: Lower bounds of the leaf size buckets.
LEAF_BUCKETS = (256, 512, 1024, 2048, 4096)


def leaf_sizes(members: DataFrame, bounds: tuple[int, ...] = LEAF_BUCKETS) -> DataFrame:
    """bucket (its lower bound, 0 below all), leaves, points."""
    sizes = members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.lit(0)
    for low in bounds:
        bucket = F.when(F.col("n") >= low, F.lit(low)).otherwise(bucket)
    return sizes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("points"))


def partition_stats(leaves: DataFrame) -> DataFrame:
    """By depth and reason: leaves, points, smallest and largest. leaves: leaf, depth, reason, id."""
    sizes = leaves.groupBy("leaf", "depth", "reason").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("depth", "reason").agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("points"), F.min("n").alias("smallest"), F.max("n").alias("largest"))


def fanout_profile(assigned: DataFrame) -> DataFrame:
    """How many points have how many leaders."""
    return assigned.groupBy("id").agg(F.count(F.lit(1)).alias("fanout")).groupBy("fanout").agg(F.count(F.lit(1)).alias("points"))


def assignment_histogram(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("leader").agg(F.count(F.lit(1)).alias("points"), F.min("d2").alias("nearest"), F.max("d2").alias("farthest"))


def degrees(graph: DataFrame) -> DataFrame:
    """nodes, edges, smallest, largest and empty degrees of (id, nbrs)."""
    d = F.size("nbrs")
    return graph.agg(F.count(F.lit(1)).alias("nodes"), F.sum(d).cast("long").alias("edges"), F.min(d).alias("smallest"), F.max(d).alias("largest"), F.sum((d == 0).cast("int")).cast("long").alias("empty"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(queries, recall): mean share of the true first k among the found first k. Both: query_id, rank, id.

    A truth of fewer than k rows is refused rather than padded: padding would make id 0 a hit.
    """
    a = found.where(F.col("rank") <= k).select("query_id", "id").distinct()
    b = truth.where(F.col("rank") <= k).select("query_id", "id").distinct()
    per = b.join(a.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    enough = F.when(F.min("n") < k, F.raise_error(F.lit(f"ground truth has fewer than {k} rows for a query"))).otherwise(F.lit(True))
    return per.agg(F.count(F.lit(1)).alias("queries"), (F.sum("hits") / (F.count(F.lit(1)) * k)).alias("recall"), enough.alias("complete")).where("complete").drop("complete")


def latency(timings: DataFrame, column: str = "seconds") -> DataFrame:
    """p50: the element at n / 2 of the sorted timings; p99: that at round(0.99 * n), at most the last."""
    w = Window.orderBy(column)
    ranked = timings.select(column, (F.row_number().over(w) - 1).alias("i"))
    n = timings.agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.crossJoin(F.broadcast(n))  # one row
    last = F.col("n") - 1
    at = lambda place: F.max(F.when(F.col("i") == F.least(place, last), F.col(column)))
    return ranked.agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 0.99 + 0.5)).alias("p99"))
