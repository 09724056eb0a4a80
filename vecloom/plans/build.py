"""From vectors to a graph: sketches, partition, neighbours in leaves, bounded candidates, final selection, start node."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hyperplanes
from ..functions.vector import residual_hash
from ..operators import knn, reduce, stats
from ..operators.arrow import batch, matrix
from ..operators.partition import partition
from ..params import BuildParams
from ..runtime import stored


@dataclass
class Graph:
    """nodes: (id, nbrs). profile: seconds and counts of each step."""

    nodes: DataFrame
    start: int | None
    params: BuildParams
    profile: dict

    def profile_json(self) -> str:
        return json.dumps({"params": asdict(self.params), **self.profile}, sort_keys=True)


def sketches(vectors: DataFrame, m: int, seed: int) -> DataFrame:
    """(id, sketch): projections on m random hyperplanes, an Arrow product for each batch."""
    dims = vectors.select(F.size("vec")).first()
    planes = hyperplanes(dims[0] if dims else 1, m, seed).astype("float64")

    def project(batches):
        for part in batches:
            x = matrix(part.column(1)).astype("float64")
            if len(x):
                yield batch(["id", "sketch"], part.column(0), list(x @ planes.T))

    return vectors.select("id", "vec").mapInArrow(project, "id long, sketch array<double>")


def build(vectors: DataFrame, p: BuildParams) -> Graph:
    """The whole build. vectors: id long, vec array<float>, distinct ids, equal lengths."""
    profile: dict = {"seconds": {}}
    clock = time.perf_counter()

    def step(name: str, df: DataFrame) -> DataFrame:
        nonlocal clock
        out = stored(df, f"build-{name}")
        now = time.perf_counter()
        profile["seconds"][name], clock = round(now - clock, 3), now
        return out

    total = vectors.count()
    leaves = step("leaves", partition(vectors, p))
    members = leaves.select("leaf", "id").join(vectors, "id")
    found = step("neighbours", knn.group_neighbours(members, p.leaf_knn, p.leaf_cap))
    every = knn.edges(found)
    hashed = knn.with_hash(every, sketches(vectors, p.m_bits, p.seed), residual_hash("_sp", "_sc"))
    if p.final_prune == "lune":
        width = reduce.lune_candidates(every, p.lune_candidates())
        kept = reduce.lune_retained(reduce.lune_witnesses(found, members), width, p.lune_witnesses)
        rows = reduce.lune_select(reduce.lune_rows(width, kept), p.max_degree, p.lune_core).select(F.col("p").alias("id"), "nbrs")
    else:
        rule = {"nearest": reduce.prune_nearest, "bucket": reduce.prune_bucket, "ordered": reduce.prune_ordered}[p.reservoir]
        kept = step("candidates", rule(hashed, p.l_max, sources=total) if p.reservoir == "ordered" else rule(hashed, p.l_max))
        if p.final_prune == "robust":
            rows = reduce.prune_robust(kept, vectors, p.max_degree, sources=total).select(F.col("p").alias("id"), "nbrs")
        elif p.final_prune == "spine":
            ranked = reduce.overlay_ranked(reduce.overlay_retained(reduce.overlay_support(every), p.max_degree), p.max_degree)
            rows = reduce.overlay_select(kept, ranked, p.max_degree, p.spine_budget).select(F.col("p").alias("id"), "nbrs")
        else:
            rows = reduce.adjacency(kept, vectors).withColumn("nbrs", F.slice("nbrs", 1, p.max_degree))
    nodes = vectors.select("id").join(rows, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))
    nodes = step("graph", nodes)
    n = nodes.count()
    start = p.start
    if start is None and n:
        pick = stats.medoid(vectors) if p.final_prune == "none" else stats.sampled_medoid(vectors, n)
        first = pick.first()
        start = None if first is None else first["id"]
    elif start is not None and nodes.where(F.col("id") == start).isEmpty():
        raise ValueError(f"start node {start} isn't in the graph")
    profile |= {"points": n, "places": leaves.count(), "leaves": leaves.select("leaf").distinct().count(), "degrees": stats.degrees(nodes).first().asDict() if n else {}}
    return Graph(nodes, start, p, profile)
