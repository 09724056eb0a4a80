"""Recursive overlapping partition by sampled leaders, one level of all nodes at a time.

A level is a table (node, id). Nodes that a stop rule holds for become leaves; in
the others leaders are sampled, every point joins its nearest leaders, small
clusters are packed together and the clusters are the next level's nodes. A node
that its leaders leave whole is tried again with others. Leaves over the cap are
cut along nearest leaders too, by runs of ids only where that fails. A node's points are dealt to blocks, each with a copy of the node's leaders (at
most max_leaders), so the root is spread like any other; sizes, samples and
packing are grouped by node and never collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..params import DEPTH_FACTORS, SHARE_BOUNDS, SIZE_FACTORS, BuildParams
from ..runtime import stored
from .arrow import matrix
from .sampling import bottom_k_by

#: Points of a node in one block of the assignment; the largest leaf that is never split by force.
BLOCK_POINTS, HARD_LEAF = 20_000, 8000
#: How often leaders are sampled anew for a node that they don't divide, or for a leaf that must be cut.
ATTEMPTS = 6
MEMBERS = "node string, id long"


def pack_clusters(sizes: list[tuple[int, int]], c_min: int, c_max: int) -> dict[int, int]:
    """cluster -> group: clusters in order of size; those under c_min are gathered while they fit c_max, the first
    cluster of c_min and more takes what was gathered if it fits, a rest joins the last group if it fits."""
    groups: list[list] = []
    open_ids: list[int] = []
    open_size = 0

    def close() -> None:
        nonlocal open_ids, open_size
        if open_ids:
            groups.append([open_size, open_ids])
        open_ids, open_size = [], 0

    for cluster, size in sorted((x for x in sizes if x[1] > 0), key=lambda x: (x[1], x[0])):
        fits = bool(open_ids) and open_size + size <= c_max
        if size < c_min:
            if not fits:
                close()
            open_ids, open_size = [*open_ids, cluster], open_size + size
        elif fits:
            groups.append([open_size + size, [*open_ids, cluster]])
            open_ids, open_size = [], 0
        else:
            close()
            groups.append([size, [cluster]])
    if open_ids and groups and groups[-1][0] + open_size <= c_max:
        groups[-1][1] += open_ids
    else:
        close()
    return {cluster: g for g, (_, ids) in enumerate(groups) for cluster in ids}


def leader_count(n: Column, depth: int, p: BuildParams) -> Column:
    """BuildParams.leaders (at depth 0: root_leaders) as an expression."""
    if depth == 0:
        return F.least(F.greatest(F.round(n * F.lit(p.psamp)).cast("int"), F.lit(1)), F.lit(p.max_leaders), n.cast("int"))
    share = F.lit(1.0)
    for size, factor in reversed(SIZE_FACTORS):
        share = F.when(n >= size, F.lit(factor)).otherwise(share)
    share = share * F.lit(p.psamp * next((f for d, f in DEPTH_FACTORS if depth > d), 1.0))
    share = F.least(F.greatest(share, F.lit(SHARE_BOUNDS[0])), F.lit(SHARE_BOUNDS[1]))
    return F.least(F.greatest(F.round(share * n).cast("int"), F.lit(2)), F.lit(p.max_leaders), n.cast("int"))


def stop_reason(depth: int, p: BuildParams, limit: int) -> Column:
    """Why a node of n points (its parent: parent_n) is a leaf; null if it isn't."""
    n = F.col("n")
    reason = F.when(F.lit(depth >= p.max_depth), "max_depth")
    if depth >= 3:
        reason = reason.when(F.col("parent_n") / n < p.min_shrink_ratio, "shrink_ratio")
    reason = reason.when(n <= limit, "natural_size")
    if depth >= 3:
        reason = reason.when(n <= 2 * limit, "min_recurse")
    if depth >= 5:
        reason = reason.when(n < 3 * limit, "small_deep")
    return reason


def _assign_blocks(fanout: int, epsilon: float | None, group: int):
    def assign(points, leaders):
        if not len(points) or not len(leaders):
            return pa.table({"node": pa.array([], pa.string()), "id": pa.array([], pa.int64()), "leader": pa.array([], pa.int64())})
        leaders = leaders.sort_by("place")
        places, y = leaders["place"].to_numpy().astype(np.int64), matrix(leaders["lv"])
        ids, x = points["id"].to_numpy(), matrix(points["vec"])
        k = min(fanout, len(places), 32)
        a, b, _, _ = kernels.top_k(x, y, places, k) if epsilon is None else kernels.sampled_top_k(x, y, places, k, epsilon, group)[0]
        return pa.table({"node": pa.array([points["node"][0].as_py()] * len(a), pa.string()), "id": ids[a], "leader": places[b]})

    return assign


def _pack(c_min: int, c_max: int):
    def pack(table):
        groups = pack_clusters(list(zip(table["leader"].to_pylist(), table["size"].to_pylist(), strict=True)), c_min, c_max)
        return pa.table({"node": pa.array([table["node"][0].as_py()] * len(groups), pa.string()), "leader": pa.array(list(groups), pa.int64()), "child": pa.array(list(groups.values()), pa.int64())})

    return pack


def _divide(rows: DataFrame, vectors: DataFrame, p: BuildParams, limit: int, fanout: int, epsilon: float | None) -> tuple[DataFrame, DataFrame]:
    """rows (node, id, n, k, seed) -> points with their leaders' places (node, id, leader), packed clusters (node, leader, child)."""
    blocks = F.ceil(F.col("n") / BLOCK_POINTS).cast("int")
    picked = bottom_k_by(rows.select("node", "id", "k", "seed", "n"), "node", "k", "seed", p.max_leaders)
    leaders = picked.join(vectors.select("id", F.col("vec").alias("lv")), "id").select(F.col("node").alias("ln"), "place", "lv", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("lb"))
    points = rows.select("node", "id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")).join(vectors, "id")
    sides = points.select("node", "id", "vec", "block").groupBy("node", "block").cogroup(leaders.groupBy("ln", "lb"))
    assigned = stored(sides.applyInArrow(_assign_blocks(fanout, epsilon, p.ads_group), "node string, id long, leader long"), "partition-assigned")
    counts = assigned.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("size"))
    packed = stored(counts.groupBy("node").applyInArrow(_pack(p.c_min, limit), "node string, leader long, child long"), "partition-packed")
    return assigned, packed


def _again(pending: DataFrame, attempt: int) -> DataFrame:
    return pending.withColumn("seed", F.xxhash64("seed", F.lit(attempt))) if attempt else pending


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def partition(vectors: DataFrame, p: BuildParams, epsilon: float | None = None) -> DataFrame:
    """leaf, depth, reason, id: overlapping leaves that cover all ids. vectors: id, vec with distinct ids."""
    total = vectors.count()
    limit = p.size_limit(total)
    level = vectors.select(F.lit("0").alias("node"), "id")
    parents = None
    leaves: list[DataFrame] = []
    for depth in range(p.max_depth + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.withColumn("parent_n", F.lit(total)) if parents is None else sizes.withColumn("parent", F.regexp_replace("node", r"\.\d+$", "")).join(parents, "parent")
        sizes = stored(sizes.select("node", "n", "parent_n", stop_reason(depth, p, limit).alias("reason"), leader_count(F.col("n"), depth, p).alias("k"), F.xxhash64("node", F.lit(p.seed)).alias("seed")), "partition-sizes")
        done = sizes.where("reason IS NOT NULL").select("node", "reason")
        leaves.append(level.join(done, "node").select(F.col("node").alias("leaf"), F.lit(depth).alias("depth"), "reason", "id"))
        pending = active = sizes.where("reason IS NULL")
        if active.isEmpty():
            break
        pieces = []
        for attempt in range(ATTEMPTS):
            rows = level.join(_again(pending, attempt), "node")
            assigned, packed = _divide(rows, vectors, p, limit, p.fanout(depth), epsilon if depth <= 1 else None)
            split = packed.groupBy("node").agg(F.countDistinct("child").alias("children"))
            parts = packed.join(split.where("children > 1"), "node").select("node", "leader", "child")
            pieces.append(assigned.join(parts, ["node", "leader"]).select(F.concat_ws(".", "node", F.col("child").cast("string")).alias("node"), "id").distinct())
            pending = stored(pending.join(split.where("children <= 1"), "node", "left_semi"), "partition-pending")
            if pending.isEmpty():
                break
        else:
            leaves.append(level.join(pending, "node", "left_semi").select(F.col("node").alias("leaf"), F.lit(depth).alias("depth"), F.lit("partition_fallback").alias("reason"), "id"))
        level = stored(_union(pieces), "partition-level")
        parents = active.select(F.col("node").alias("parent"), F.col("n").alias("parent_n"))
    return split_large(_union(leaves), vectors, p, min(HARD_LEAF, p.leaf_cap))


def split_large(leaves: DataFrame, vectors: DataFrame, p: BuildParams, cap: int) -> DataFrame:
    """Leaves of more than `cap` points cut into packed clusters of at most `cap`; all others as they are.

    Every point joins the nearest of ceil(n / cap) sampled leaders; if a cluster is too large, twice as many are
    sampled (at most max_leaders). What no attempt divides (copies of one vector) is cut into even runs of ids.
    """
    leaves = stored(leaves, "partition-leaves")
    large = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    if large.isEmpty():
        return leaves
    pending = stored(large.select(F.col("leaf").alias("node"), "n", F.ceil(F.col("n") / cap).cast("int").alias("k"), F.xxhash64("leaf", F.lit(p.seed)).alias("seed")), "partition-large")
    large = pending.select(F.col("node").alias("leaf"))
    points = stored(leaves.join(large, "leaf", "left_semi").select(F.col("leaf").alias("node"), "depth", "id"), "partition-cut")
    out = [leaves.join(large, "leaf", "left_anti")]
    forced = lambda df, piece: df.select(F.concat_ws("/", "node", piece.cast("string")).alias("leaf"), "depth", F.lit("forced_split").alias("reason"), "id")
    for attempt in range(ATTEMPTS):
        more = F.least(F.col("k") * (1 << attempt), F.lit(p.max_leaders), F.col("n").cast("int"))
        rows = points.select("node", "id").join(_again(pending, attempt).withColumn("k", more), "node")
        assigned, packed = _divide(rows, vectors, p, cap, 1, None)
        pieces = stored(assigned.join(packed, ["node", "leader"]).select("node", "id", "child"), "partition-pieces")
        bad = pieces.groupBy("node", "child").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > cap).select("node").distinct()
        out.append(forced(pieces.join(bad, "node", "left_anti").join(points, ["node", "id"]), F.col("child")))
        pending = stored(pending.join(bad, "node", "left_semi"), "partition-large")
        if pending.isEmpty():
            return _union(out)
    place = F.row_number().over(Window.partitionBy("node").orderBy("id")) - 1
    run = F.floor(place * F.ceil(F.col("n") / cap) / F.col("n"))
    out.append(forced(points.join(pending.select("node", "n"), "node"), run))
    return _union(out)
