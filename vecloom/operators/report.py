"""Reports on assignments, selections and graphs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inverted_index(assigned: DataFrame) -> DataFrame:
    """(leader, points, ids): which points are nearest to each leader, by id. Groups are clusters of a partition, bounded by its sizes."""
    near = assigned.where("rank = 1")
    return near.groupBy("leader").agg(F.count(F.lit(1)).alias("points"), F.array_sort(F.collect_list("id")).alias("ids"))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(rows, same, shared, edges) of two graphs (id, nbrs): equal rows and neighbours in common."""
    both = left.select("id", F.col("nbrs").alias("a")).join(right.select("id", F.col("nbrs").alias("b")), "id")
    shared = F.size(F.array_intersect("a", "b"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("same"), F.sum(shared).cast("long").alias("shared"), F.sum(F.size("b")).cast("long").alias("edges"))


def selection(candidates: DataFrame, retained: DataFrame, selected: DataFrame) -> DataFrame:
    """One row of counts of a lune selection: sources, candidates, witnesses, victims, edges, skipped, filled."""
    a = candidates.agg(F.countDistinct("p").alias("sources"), F.count(F.lit(1)).alias("candidates"))
    b = retained.agg(F.count(F.lit(1)).alias("witnesses"), F.countDistinct("src", "victim").alias("victims"))
    c = selected.agg(F.sum(F.size("nbrs")).cast("long").alias("edges"), F.sum("skipped").alias("skipped"), F.sum("filled").alias("filled"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def selection_json(counts: DataFrame, graph: DataFrame | None = None, base: DataFrame | None = None) -> str:
    """The counts, and the overlap with a base graph if both are given, as JSON."""
    out = {"report": "lune_selection", **counts.first().asDict()}
    if graph is not None and base is not None:
        out["base"] = overlap(graph, base).first().asDict()
    return json.dumps(out, sort_keys=True)


def agreement(found: DataFrame, exact: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(rows, hits): how many exact rows (by all keys) an approximate result holds."""
    return exact.select(*keys).distinct().join(found.select(*keys).distinct().withColumn("hit", F.lit(1)), list(keys), "left").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("hits"))
