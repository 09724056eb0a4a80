"""Bounded candidate lists by source: three reservoir rules, overlay support, lune candidates and witnesses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import truncate_bf16
from ..functions.vector import SHADE, family_bit, is_shaded, rank_weight, shade_margin, squared_l2, witness_key
from .arrow import matrix
from .knn import LEAF_ROWS

#: Sources that share a task in grouped Python steps.
SOURCES_PER_TASK = 2000


def distinct_targets(candidates: DataFrame) -> DataFrame:
    """The nearest entry of each (p, c); ties go to the smaller hash."""
    best = F.min(F.struct("d2", "hash")).alias("m")
    return candidates.groupBy("p", "c").agg(best).select("p", "c", "m.hash", "m.d2")


def _nearest(rows: DataFrame, l_max: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("p").orderBy("d2", "c"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= l_max).select("p", "c", "hash", "d2", "rank")


def prune_nearest(candidates: DataFrame, l_max: int) -> DataFrame:
    """The l_max nearest distinct targets. Without overflow this is what any order of insertion leaves."""
    return _nearest(distinct_targets(candidates), l_max)


def prune_bucket(candidates: DataFrame, l_max: int) -> DataFrame:
    """One target of each hash bucket (the nearest), then the l_max nearest: an order-free variant of our own."""
    best = F.min(F.struct("d2", "c")).alias("m")
    rows = distinct_targets(candidates).groupBy("p", "hash").agg(best).select("p", "m.c", "hash", "m.d2")
    return _nearest(rows, l_max)


class Reservoir:
    """At most `size` targets of one source. Once full, a newcomer competes within its hash bucket if that has a
    member, else with the farthest of all; a known target only gets nearer."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.kept: dict[int, tuple[int, float]] = {}

    def insert(self, target: int, code: int, d2: float) -> None:
        kept = self.kept
        if target in kept:
            if d2 < kept[target][1]:
                kept[target] = (code, d2)
        elif len(kept) < self.size:
            kept[target] = (code, d2)
        else:
            rivals = [t for t, (h, _) in kept.items() if h == code] or list(kept)
            worst = max(rivals, key=lambda t: (kept[t][1], t))
            if d2 < kept[worst][1]:
                del kept[worst]
                kept[target] = (code, d2)

    def rows(self) -> list[tuple[int, int, float]]:
        """(target, hash, d2) by hash, then target."""
        return sorted(((t, h, d) for t, (h, d) in self.kept.items()), key=lambda r: (r[1], r[0]))


def _by_source(df: DataFrame, sources: int | None) -> DataFrame:
    """df with a task for each source: SOURCES_PER_TASK share one, however many sources there are."""
    if sources is None:
        sources = df.agg(F.approx_count_distinct("p")).first()[0]
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sources // SOURCES_PER_TASK))
    return df.withColumn("task", F.pmod(F.xxhash64("p"), F.lit(tasks)))


def prune_ordered(candidates: DataFrame, l_max: int, half_precision: bool = False, sources: int | None = None) -> DataFrame:
    """The reservoir rule over each source's candidates in a declared order: leaf, source place (p), rank, direct first, target.

    candidates: leaf, p, c, hash, d2, rank, direct. Sources (how many, if known) are dealt to tasks by hash; a source's candidates are bounded by its leaves.
    """

    def fold(table):
        table = table.sort_by([("p", "ascending"), ("leaf", "ascending"), ("rank", "ascending"), ("direct", "descending"), ("c", "ascending")])
        p, c, code, d2 = (table[x].to_numpy() for x in ("p", "c", "hash", "d2"))
        d2 = truncate_bf16(d2).astype(np.float64) if half_precision else d2
        out: list[tuple] = []
        for part in np.split(np.arange(len(p)), np.flatnonzero(p[1:] != p[:-1]) + 1):
            kept = Reservoir(l_max)
            for i in part.tolist():
                kept.insert(int(c[i]), int(code[i]), float(d2[i]))
            out += [(int(p[part[0]]), t, h, d, n) for n, (t, h, d) in enumerate(kept.rows(), 1)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32()), strict=True)], ["p", "c", "hash", "d2", "rank"])

    leaf = candidates.withColumn("direct", F.col("direct").cast("int"))
    return _by_source(leaf, sources).groupBy("task").applyInArrow(fold, "p long, c long, hash int, d2 double, rank int")


def adjacency(kept: DataFrame, ids: DataFrame, order: str = "rank") -> DataFrame:
    """(id, nbrs): every id has a row, empty if it has no neighbours."""
    lists = kept.groupBy(F.col("p").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "c"))), lambda x: x["c"]).alias("nbrs"))
    return ids.select("id").join(lists, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


def overlay_support(edge: DataFrame, family: str = "leaf", bits: bool = True) -> DataFrame:
    """p, c, d2, family_support, reciprocal_support, rank_mass, best_rank of each candidate over the views it occurs in.

    bits: views that share one of 64 bits count once; of several ranks in a view the smallest counts.
    """
    number = F.pmod(F.xxhash64(family), F.lit(1 << 32)) if dict(edge.dtypes)[family] == "string" else F.col(family)
    view = family_bit(number) if bits else F.col(family)
    per = edge.withColumn("_v", view).groupBy("p", "c", "_v").agg(
        F.min("d2").alias("d2"), F.min(F.when(F.col("direct"), F.greatest(F.col("rank"), F.lit(1)))).alias("rank"), F.max((~F.col("direct")).cast("int")).alias("mirror")
    )
    return per.groupBy("p", "c").agg(
        F.min("d2").alias("d2"), F.count("rank").alias("family_support"), F.sum("mirror").cast("long").alias("reciprocal_support"),
        F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), rank_weight("rank"))), F.lit(0)).cast("long").alias("rank_mass"), F.coalesce(F.min("rank"), F.lit(255)).cast("int").alias("best_rank"),
    )


OVERLAY_SLOTS = 16


def overlay_retained(support: DataFrame, max_degree: int) -> DataFrame:
    """At most OVERLAY_SLOTS candidates of a source, by the order in which they'd be evicted last."""
    order = [F.desc("family_support"), F.desc("rank_mass"), "best_rank", F.desc("reciprocal_support"), "d2", "c"]
    rank = F.row_number().over(Window.partitionBy("p").orderBy(*order))
    return support.withColumn("slot", rank).where(F.col("slot") <= min(OVERLAY_SLOTS, max_degree))


def overlay_ranked(retained: DataFrame, max_degree: int) -> DataFrame:
    """Retained candidates in order of stability."""
    order = [F.desc("family_support"), F.desc("reciprocal_support"), F.desc("rank_mass"), "best_rank", "d2", "c"]
    return retained.withColumn("place", F.row_number().over(Window.partitionBy("p").orderBy(*order))).where(F.col("place") <= max_degree)


def overlay_select(base: DataFrame, ranked: DataFrame, max_degree: int, budget: int, order: str = "hash") -> DataFrame:
    """(p, nbrs): the base row's prefix, then up to `budget` new overlay targets, then the rest of the base row.

    base: p, c, hash, d2; its order is by hash (as reservoirs emit) or by d2.
    """
    if not 0 <= budget <= max_degree:
        raise ValueError("the overlay budget must be at most the degree")
    rows = base.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "c"))), lambda x: x["c"]).alias("_b"))
    over = ranked.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"]).alias("_o"))
    both = rows.join(over, "p", "left").withColumn("_o", F.coalesce("_o", F.array().cast("array<bigint>")))
    head = F.slice("_b", 1, max_degree - budget)
    more = F.slice(F.array_except("_o", head), 1, budget)
    return both.select("p", F.slice(F.array_distinct(F.concat(head, more, "_b")), 1, max_degree).alias("nbrs"))


def lune_candidates(edge: DataFrame, width: int) -> DataFrame:
    """p, c, d2, rank: the `width` nearest distinct targets of each source."""
    rows = edge.groupBy("p", "c").agg(F.min("d2").alias("d2"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("p").orderBy("d2", "c"))).where(F.col("rank") <= width)


WITNESSES = "src long, pivot long, victim long, margin int, pivot_rank int, victim_rank int"


def _leaf_witnesses(near, members):
    """Witnesses of some sources of one leaf, from the vectors that the task holds anyway."""
    names = ["leaf", "src", "pivot", "victim", "margin", "pivot_rank", "victim_rank"]
    if not len(near) or not len(members):
        return pa.table([near["leaf"].slice(0, 0), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names)
    near = near.sort_by([("p", "ascending"), ("rank", "ascending")])
    p, c, rank, d2 = (near[x].to_numpy() for x in ("p", "c", "rank", "d2"))
    ids = members["id"].to_numpy()
    order = np.argsort(ids)
    x, place = matrix(members["vec"]), order[np.searchsorted(ids[order], c)]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    size = np.diff(np.r_[first, len(p)])
    at, end = np.arange(len(p)), np.repeat(first + size, size)
    got = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
    for step in range(1, int(size.max())):  # a row's pivot and the victim `step` places after it
        a = at[at + step < end]
        for s in range(0, len(a), 4096):
            i = a[s : s + 4096]
            j = i + step
            pv = np.cumsum((x[place[i]].astype(np.float64) - x[place[j]].astype(np.float64)) ** 2, axis=1)[:, -1]  # in index order
            hit = (rank[i] < rank[j]) & (pv < d2[j] / SHADE)
            got.append((i[hit], j[hit], pv[hit]))
    i, j, pv = (np.concatenate(v) for v in zip(*got, strict=True))
    reach = d2[j] / SHADE
    share = np.where(reach > 0, np.clip((reach - pv) / np.where(reach > 0, reach, 1), 0, 1), 0.0)
    margin = np.floor(share * 65535 + 0.5).astype(np.int32)
    return pa.table([near["leaf"].combine_chunks().take(pa.array(i)), pa.array(p[i]), pa.array(c[i]), pa.array(c[j]), pa.array(margin), pa.array(rank[i].astype(np.int32)), pa.array(rank[j].astype(np.int32))], names)


def lune_witnesses(neighbours: DataFrame, members: DataFrame) -> DataFrame:
    """leaf, src, pivot, victim, margin, pivot_rank, victim_rank: earlier neighbours that shade later ones in a leaf.

    members: leaf, id, vec, as for the neighbours. A leaf's rows meet its vectors once, in one task, so a vector isn't
    fetched for every pair. Leaves of more than LEAF_ROWS vectors fetch them for their pairs by id instead.
    """
    kind = neighbours.schema["leaf"].dataType.simpleString()
    near, rows = neighbours.select("leaf", "p", "c", "rank", "d2"), members.select("leaf", "id", "vec")
    large = rows.groupBy(F.col("leaf").alias("_leaf")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LEAF_ROWS).select("_leaf")
    same = F.col("leaf").eqNullSafe(F.col("_leaf"))
    of_small = lambda df: df.join(large, same, "left_anti").groupBy("leaf")
    out = of_small(near).cogroup(of_small(rows)).applyInArrow(_leaf_witnesses, f"leaf {kind}, {WITNESSES}")
    if large.isEmpty():
        return near.groupBy("leaf").cogroup(rows.groupBy("leaf")).applyInArrow(_leaf_witnesses, f"leaf {kind}, {WITNESSES}")
    wide = near.join(large, same, "left_semi")
    a = wide.select("leaf", F.col("p").alias("src"), F.col("c").alias("pivot"), F.col("rank").alias("pivot_rank"))
    b = wide.select(F.col("leaf").alias("_l"), F.col("p").alias("_s"), F.col("c").alias("victim"), F.col("rank").alias("victim_rank"), F.col("d2").alias("sv"))
    pairs = a.join(b, F.col("leaf").eqNullSafe(F.col("_l")) & (F.col("src") == F.col("_s")) & (F.col("pivot_rank") < F.col("victim_rank"))).drop("_l", "_s")
    vec = rows.join(large, same, "left_semi")
    left, right = vec.select(F.col("leaf").alias("_l"), F.col("id").alias("pivot"), F.col("vec").alias("_p")), vec.select(F.col("leaf").alias("_m"), F.col("id").alias("victim"), F.col("vec").alias("_v"))
    pairs = pairs.join(left, (F.col("leaf").eqNullSafe(F.col("_l"))) & (pairs["pivot"] == left["pivot"])).drop(left["pivot"], "_l")
    pairs = pairs.join(right, (F.col("leaf").eqNullSafe(F.col("_m"))) & (pairs["victim"] == right["victim"])).drop(right["victim"], "_m").withColumn("pv", squared_l2("_p", "_v"))
    return out.unionByName(pairs.where(is_shaded("sv", "pv")).select("leaf", "src", "pivot", "victim", shade_margin("sv", "pv").alias("margin"), "pivot_rank", "victim_rank"))


def lune_retained(witnesses: DataFrame, candidates: DataFrame, cap: int) -> DataFrame:
    """src, victim, pivot, key: the best `cap` pivots of each victim among witnesses whose both ends are candidates."""
    ends = candidates.select(F.col("p").alias("src"), F.col("c"))
    kept = witnesses.join(ends.select("src", F.col("c").alias("victim")), ["src", "victim"], "left_semi").join(ends.select("src", F.col("c").alias("pivot")), ["src", "pivot"], "left_semi")
    best = kept.groupBy("src", "victim", "pivot").agg(F.min(witness_key("pivot_rank", "margin", "victim_rank")).alias("key"))
    rank = F.row_number().over(Window.partitionBy("src", "victim").orderBy("key", "pivot"))
    return best.withColumn("place", rank).where(F.col("place") <= cap)


def lune_rows(candidates: DataFrame, retained: DataFrame) -> DataFrame:
    """p, cands (c by distance), pivots (victim -> its pivots): bounded rows for the selection."""
    cands = candidates.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("d2", "c"))), lambda x: x["c"]).alias("cands"))
    shades = retained.groupBy(F.col("src").alias("p"), "victim").agg(F.collect_list("pivot").alias("pv"))
    shades = shades.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("victim", "pv"))).alias("pivots"))
    return cands.join(shades, "p", "left")


def lune_select(rows: DataFrame, max_degree: int, core: int = 0) -> DataFrame:
    """(p, nbrs, skipped, filled): nearest first, but not what a chosen pivot shades; then filled up by distance.

    A fold over each row's bounded candidate array; rows that fit the degree are kept as they are.
    """
    none = F.array().cast("array<bigint>")
    full = lambda s: F.size(s["take"]) >= max_degree
    start = F.struct(none.alias("take"), F.lit(0).cast("long").alias("skipped"))

    def step(s, c):
        shaded = F.coalesce(F.arrays_overlap(F.coalesce(F.try_element_at(F.coalesce(F.col("pivots"), F.map_from_arrays(none, F.array().cast("array<array<bigint>>"))), c), none), s["take"]), F.lit(False))
        skip = (F.size(s["take"]) >= core) & shaded
        more = F.struct(F.when(skip, s["take"]).otherwise(F.array_append(s["take"], c)).alias("take"), (s["skipped"] + skip.cast("long")).alias("skipped"))
        return F.when(full(s), s).otherwise(more)

    chosen = rows.withColumn("_s", F.aggregate("cands", start, step))
    small = F.size("cands") <= max_degree
    nbrs = F.slice(F.concat("_s.take", F.array_except("cands", "_s.take")), 1, max_degree)
    return chosen.select("p", F.when(small, F.col("cands")).otherwise(nbrs).alias("nbrs"), F.when(small, 0).otherwise(F.col("_s.skipped")).cast("long").alias("skipped"), F.when(small, 0).otherwise(F.size(nbrs) - F.size("_s.take")).cast("long").alias("filled"))


def robust_select(source: int, pool: list[tuple[int, float]], vectors: dict[int, np.ndarray], max_degree: int, saturate: bool = True, cap: int = 750, alphas: tuple[float, ...] = (1.0, 1.2)) -> list[int]:
    """Occlusion pruning: take the nearest; it shades those much nearer to it than to the source. Two passes with growing
    tolerance, then filled up by distance if `saturate`. Distances are squared; a copy of a chosen one is shaded."""
    order = sorted({c: d for c, d in sorted(pool, key=lambda x: -x[1]) if c != source}.items(), key=lambda x: (x[1], x[0]))[:cap]
    if not order:
        return []
    ids, near = [c for c, _ in order], np.array([d for _, d in order])
    x = np.stack([vectors[c] for c in ids]).astype(np.float64)
    shade, taken, chosen = np.zeros(len(ids)), np.zeros(len(ids), bool), []
    for alpha in alphas:
        for i in range(len(ids)):
            if len(chosen) >= max_degree:
                break
            if taken[i] or shade[i] > alpha:
                continue
            taken[i] = True
            chosen.append(ids[i])
            apart = np.cumsum((x - x[i]) ** 2, axis=1)[:, -1]  # in index order
            with np.errstate(divide="ignore", invalid="ignore"):
                shade = np.maximum(shade, np.where(apart == 0, np.inf, near / apart))
    if saturate:
        chosen += [c for c, t in zip(ids, taken, strict=True) if not t][: max(0, max_degree - len(chosen))]
    return chosen


def prune_robust(candidates: DataFrame, vectors: DataFrame, max_degree: int, saturate: bool = True, cap: int = 750, sources: int | None = None) -> DataFrame:
    """(p, nbrs) by occlusion pruning. candidates: p, c, d2; target vectors are fetched by id, sources dealt to tasks by hash."""
    rows = candidates.join(vectors.select(F.col("id").alias("c"), "vec"), "c")

    def select(table):
        p, c, d2 = (table[x].to_numpy() for x in ("p", "c", "d2"))
        vec = matrix(table["vec"]) if len(p) else np.zeros((0, 1))
        order = np.argsort(p, kind="stable")
        out = []
        for part in np.split(order, np.flatnonzero(p[order][1:] != p[order][:-1]) + 1):
            own = {int(c[i]): vec[i] for i in part}
            out.append((int(p[part[0]]), robust_select(int(p[part[0]]), [(int(c[i]), float(d2[i])) for i in part], own, max_degree, saturate, cap)))
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.list_(pa.int64()))], ["p", "nbrs"])

    return _by_source(rows.select("p", "c", "d2", "vec"), sources).groupBy("task").applyInArrow(select, "p long, nbrs array<bigint>")
