"""Golden values, exactness against brute force, and properties of the graph engine."""

import math
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.functions import hashing, kernels
from vecloom.functions import vector as V
from vecloom.operators import knn, reduce, report, sampling, search, stats
from vecloom.operators.partition import leader_count, pack_clusters, partition, split_large
from vecloom.params import BuildParams
from vecloom.plans import reuse
from vecloom.plans.build import build

TINY = BuildParams(c_min=2, c_max=8, max_depth=6, max_leaders=32, psamp=0.1, fanout_top=4, fanout_second=2, max_degree=16, l_max=16, leaf_knn=3)


def ramp(spark, n, dims=8):
    rows = [(r, [r * 0.25 + c * 0.5 for c in range(dims)]) for r in range(n)]
    return spark.createDataFrame(rows, "id long, vec array<float>")


def random_vectors(spark, n, dims=16, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>"), x


def test_splitmix_and_scores():
    assert hashing.splitmix64(np.array([0], np.uint64))[0] == 0xE220A8397B1DCDAF
    want = {3: 0x5242164E292DCD5D, 5: 0xE948B15819680BD8, 7: 0xFE6C344A16E66489, 9: 0x412F3956E61F5666}
    got = hashing.sample_score(np.array(list(want)), 17)
    assert [int(x) for x in got] == list(want.values())


def test_bottom_k(spark):
    ids = spark.createDataFrame([(x,) for x in (42, 7, 9, 100, 3, 81, 12, 5, 3)], "id long")
    pick = lambda k, seed: [r[0] for r in sampling.bottom_k(ids, k, seed).orderBy("place").collect()]
    assert pick(4, 17) == [9, 3, 42, 12]
    assert pick(4, 18) != pick(4, 17)
    assert sorted(pick(99, 17)) == [3, 5, 7, 9, 12, 42, 81, 100]
    assert pick(0, 17) == []


def test_params_rules():
    p = BuildParams()
    assert [p.leader_share(n, d) for n, d in ((10_000, 0), (10_000_000, 0), (10_000_000, 3))] == pytest.approx([0.001, 0.0001, 0.00005])
    assert [BuildParams(fanout_top=8).fanout(d) for d in (0, 1, 4)] == [8, 3, 1]
    assert p.size_limit(5_000_000) == 4096 and p.size_limit(4_999_999) == 2048
    for bad in ({"c_min": 0}, {"c_min": 9000}, {"leaf_knn": 0}, {"m_bits": 17}, {"psamp": math.nan}, {"metric": "cosine"}, {"spine_budget": 99}, {"lune_width": 0.0}, {"final_prune": "x"}):
        with pytest.raises(ValueError):
            BuildParams(**bad)


def test_leader_count_expression(spark):
    p = BuildParams(psamp=0.01)
    for depth in (0, 1, 3, 5):
        for n in (3, 100, 250_000, 6_000_000, 30_000_000):
            want = p.root_leaders(n) if depth == 0 else p.leaders(n, depth)
            assert spark.range(1).select(leader_count(F.lit(n).cast("long"), depth, p)).first()[0] == want


def test_reservoir():
    r = reduce.Reservoir(4)
    for t, d in ((10, 10), (11, 9), (12, 8), (13, 7)):
        r.insert(t, 7, d)
    assert sorted(r.kept) == [10, 11, 12, 13]
    r.insert(14, 7, 6)
    assert sorted(r.kept) == [11, 12, 13, 14]
    r = reduce.Reservoir(4)
    r.insert(10, 7, 10.0)
    r.insert(10, 7, 8.0)
    assert r.rows() == [(10, 7, 8.0)]
    r = reduce.Reservoir(3)
    for i, d in enumerate((10, 9, 8, 7)):
        r.insert(10 + i, i + 1, d)
    assert sorted(r.kept) == [11, 12, 13]
    for order, want in (((1, 2, 3), [1, 2]), ((1, 3, 2), [1, 3])):
        r = reduce.Reservoir(2)
        for t in order:
            r.insert(t, 2 if t == 3 else 1, float(t))
        assert sorted(r.kept) == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 3), st.integers(0, 50)), max_size=40))
def test_reservoir_ascending_is_nearest(rows):
    """Fed by distance, the rule keeps the nearest distinct targets."""
    r, want = reduce.Reservoir(6), []
    for d, (t, h, _) in enumerate(sorted(rows, key=lambda x: x[2])):
        r.insert(t, h, float(d))
        if t not in want:
            want.append(t)
    assert sorted(r.kept) == sorted(want[:6])


def test_robust_golden():
    line = {i: np.eye(1, 16, dtype=np.float32)[0] * i for i in range(5)}
    assert reduce.robust_select(2, [(0, 4), (1, 1), (3, 1), (4, 4)], line, 3)[:2] == [1, 3]
    assert sorted(reduce.robust_select(2, [(2, 0), (1, 1), (3, 1), (4, 4)], line, 3)) == [1, 3, 4]
    got = reduce.robust_select(0, [(1, 1), (2, 4), (3, 9), (4, 16)], line, 4, cap=2)
    assert len(got) <= 2 and max(got) <= 2
    assert reduce.robust_select(0, [(1, 1), (1, 1)], line, 4) == [1]
    occluded = {i: np.eye(1, 16, dtype=np.float32)[0] * x for i, x in enumerate((0, 1, 1, 3))}
    assert reduce.robust_select(0, [(1, 1), (2, 1), (3, 9)], occluded, 4, saturate=False) == [1]


def test_pack_clusters():
    assert pack_clusters([(0, 3), (1, 3), (2, 20)], 8, 30) == {0: 0, 1: 0, 2: 0}
    assert pack_clusters([(0, 3), (1, 3), (2, 20)], 8, 24) == {0: 0, 1: 0, 2: 1}
    assert pack_clusters([(0, 5)], 8, 12) == {0: 0}
    assert pack_clusters([(0, 0)], 8, 12) == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=20), st.integers(1, 10), st.integers(0, 20))
def test_pack_keeps_all(sizes, c_min, more):
    c_max = c_min + more
    got = pack_clusters(list(enumerate(sizes)), c_min, c_max)
    assert sorted(got) == [i for i, s in enumerate(sizes) if s]
    for g in set(got.values()):
        own = [sizes[i] for i in got if got[i] == g]
        assert len(own) == 1 or sum(own) <= c_max


def test_kernels_agree():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(30, 12)).astype(np.float32), rng.normal(size=(200, 12)).astype(np.float32)
    ids = rng.permutation(1000)[:200]
    exact, (pruned, share) = kernels.top_k(a, b, ids, 7), kernels.sampled_top_k(a, b, ids, 7, 50.0, 4)
    for x, y in zip(exact, pruned, strict=True):
        assert np.array_equal(x, y)
    _, eager = kernels.sampled_top_k(a, b, ids, 7, 0.1, 4)
    assert eager < share <= 1
    with pytest.raises(ValueError):
        kernels.ratio_table(0, 1.0, 4)
    _, ratio = kernels.ratio_table(64, 1.0, 16)
    assert ratio[-1] == 1 and ratio[0] == pytest.approx(16 / 64 * (1 + 1 / 4) ** 2)


def test_ties_go_to_smaller_ids(spark):
    v = spark.createDataFrame([(i, [0.0, 0.0]) for i in (5, 3, 9, 1)], "id long, vec array<float>")
    got = knn.nearest(v.where("id = 5"), v, 2, skip_self=True).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 3]


def test_nearest_matches_numpy(spark):
    v, x = random_vectors(spark, 300)
    got = knn.nearest(v.where("id < 10"), v, 5, skip_self=True).collect()
    d = ((x[:10, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2)
    d[np.arange(10), np.arange(10)] = np.inf
    for q in range(10):
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(d[q], kind="stable")[:5].tolist()
    same = knn.nearest_sql(v.where("id < 10"), v, 5, skip_self=True).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, got))
    assert knn.nearest(v.where("false"), v, 5).count() == 0
    with pytest.raises(ValueError, match="bound"):
        knn.check_bound(v, 100)


def test_lune_predicate_and_selection(spark):
    row = spark.range(1).select(V.is_shaded(F.lit(1.2), F.lit(1.0)).alias("edge"), V.is_shaded(F.lit(1.21), F.lit(1.0)).alias("inside"), V.family_bit(F.lit(7)).alias("bit")).first()
    x = 7 * 0x9E3779B1 & 0xFFFFFFFF
    x = ((x << 13) | (x >> 19)) & 0xFFFFFFFF
    assert (row["edge"], row["inside"], row["bit"]) == (False, True, (x * 0x85EBCA6B) & 63)
    rows = spark.createDataFrame([(0, [1, 2, 3, 4], {2: [1], 3: [2]})], "p long, cands array<bigint>, pivots map<bigint, array<bigint>>")
    assert tuple(reduce.lune_select(rows, 2).first())[1:] == ([1, 3], 1, 0)
    assert tuple(reduce.lune_select(rows, 2, core=2).first())[1:] == ([1, 2], 0, 0)
    assert tuple(reduce.lune_select(rows, 3).first())[1:] == ([1, 3, 4], 1, 0)
    assert tuple(reduce.lune_select(rows, 9).first())[1:] == ([1, 2, 3, 4], 0, 0)


def test_overlay_select(spark):
    base = spark.createDataFrame([(0, c, h, float(c)) for h, c in enumerate((10, 11, 12, 13))], "p long, c long, hash int, d2 double")
    ranked = spark.createDataFrame([(0, 11, 1), (0, 20, 2), (0, 21, 3)], "p long, c long, place int")
    assert reduce.overlay_select(base, ranked, 4, 1).first()["nbrs"] == [10, 11, 12, 20]
    assert reduce.overlay_select(base, ranked, 5, 2).first()["nbrs"] == [10, 11, 12, 20, 21]
    with pytest.raises(ValueError):
        reduce.overlay_select(base, ranked, 2, 3)


@pytest.mark.parametrize("prune", ["none", "robust", "spine", "lune"])
def test_build_properties(spark, prune):
    v = ramp(spark, 48)
    g = build(v, replace(TINY, final_prune=prune))
    rows = g.nodes.collect()
    assert sorted(r["id"] for r in rows) == list(range(48))
    for r in rows:
        assert 0 < len(r["nbrs"]) <= 16 and r["id"] not in r["nbrs"] and len(set(r["nbrs"])) == len(r["nbrs"])
    assert 0 <= g.start < 48 and '"points": 48' in g.profile_json()


def test_partition_covers_and_reuse(spark, tmp_path):
    v, _ = random_vectors(spark, 200)
    leaves = partition(v, TINY)
    assert leaves.select("id").distinct().count() == 200
    assert leaves.groupBy("leaf", "id").count().where("count > 1").isEmpty()
    assert {r[0] for r in leaves.select("reason").distinct().collect()} <= {"max_depth", "shrink_ratio", "natural_size", "min_recurse", "small_deep", "partition_fallback", "forced_split"}
    reuse.save(leaves, v, TINY, str(tmp_path / "kept"))
    assert reuse.load(v, replace(TINY, leaf_knn=5), str(tmp_path / "kept")).count() == leaves.count()
    for other in ((v, replace(TINY, c_max=9)), (v.where("id > 0"), TINY)):
        with pytest.raises(ValueError):
            reuse.load(*other, str(tmp_path / "kept"))
    assert reuse.trace(leaves, 1).count() >= 1
    assert stats.partition_stats(leaves).agg(F.sum("points")).first()[0] == leaves.count()


def test_search_recall_and_rounds(spark):
    v, _ = random_vectors(spark, 300, 8)
    g = build(v, replace(TINY, c_max=32, c_min=8, leaf_knn=6))
    asked = v.where("id < 5")
    truth = knn.nearest(asked, v, 5)
    found = search.beam_search(asked, g.nodes, v, [60], 5, g.start)
    assert stats.recall(found, truth, 5).first()["recall"] >= 0.9
    joined = search.beam_search(asked.where("id < 2"), g.nodes, v, [20], 5, g.start, limit=0)
    local = search.beam_search(asked.where("id < 2"), g.nodes, v, [20], 5, g.start)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in joined.collect()) == sorted((r["query_id"], r["rank"], r["id"]) for r in local.collect())
    with pytest.raises(Exception, match="fewer than"):
        stats.recall(found, truth.where("rank < 3"), 5).collect()


def test_entries_reach_every_row(spark):
    """Two rings and a row that nothing links to: a search from one ring finds rows of all three, by either plan."""
    n = 40
    v = spark.createDataFrame([(i, [float(i % 20), 100.0 * (i // 20)]) for i in range(2 * n + 1)], "id long, vec array<float>")
    g = spark.createDataFrame([(i, [i // n * n + (i + 1) % n, i // n * n + (i - 1) % n] if i < 2 * n else [0]) for i in range(2 * n + 1)], "id long, nbrs array<long>")
    entries = search.entries(g, 3)
    assert {3, 2 * n} <= {r["id"] for r in entries.collect()}
    for limit in (0, search.GRAPH_BYTES):
        found = search.beam_search(v.where("id in (5, 75, 80)"), g, v, [4], 1, 3, limit=limit, entries=entries)
        assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(5, 5), (75, 75), (80, 80)]


def test_width_is_fitted(spark):
    """A path of links: neighbours of a row lie far along it, so the least width is too small."""
    v, _ = random_vectors(spark, 200, 8)
    g = spark.createDataFrame([(i, [(i + 1) % 200, (i - 1) % 200]) for i in range(200)], "id long, nbrs array<long>")
    assert search.fitted_width(g, v, 400, 5, 0) == 400
    width = search.fitted_width(g, v, 12, 5, 0)
    found = search.beam_search(v, g, v, [width], 5, 0)
    assert width > 12 and stats.recall(found, knn.nearest(v, v, 5), 5).first()["recall"] >= 0.95


def test_ordered_equals_nearest_without_overflow(spark):
    v, _ = random_vectors(spark, 60)
    n = knn.group_neighbours(v.withColumn("leaf", F.col("id") % 2), 4)
    edge = knn.edges(n).withColumn("hash", (F.col("c") % 3).cast("int"))
    a = {(r["p"], r["c"], r["d2"]) for r in reduce.prune_ordered(edge, 99).collect()}
    b = {(r["p"], r["c"], r["d2"]) for r in reduce.prune_nearest(edge, 99).collect()}
    assert a == b
    with pytest.raises(Exception, match="more than"):
        knn.group_neighbours(v.withColumn("leaf", F.lit(1)), 2, cap=10).collect()


def test_reports(spark):
    a = spark.createDataFrame([(0, [1, 2]), (1, [0])], "id long, nbrs array<bigint>")
    b = spark.createDataFrame([(0, [2, 3]), (1, [0])], "id long, nbrs array<bigint>")
    assert tuple(report.overlap(a, b).first()) == (2, 1, 2, 3)
    cands = spark.createDataFrame([(0, 1), (0, 2)], "p long, c long")
    kept = spark.createDataFrame([(0, 2, 1)], "src long, victim long, pivot long")
    chosen = spark.createDataFrame([(0, [1], 1, 0)], "p long, nbrs array<bigint>, skipped long, filled long")
    text = report.selection_json(report.selection(cands, kept, chosen), a, b)
    assert '"witnesses": 1' in text and '"shared": 2' in text


def test_large_leaves_are_compared_in_block_pairs(spark):
    """Above the rows of a block a leaf gives the same neighbours; the default takes more than 3500 rows."""
    r = np.random.default_rng(6)
    x = r.integers(0, 5, (90, 4)).tolist()  # many ties
    v = spark.createDataFrame([(None if i % 9 == 0 else i % 3, i, [float(y) for y in row]) for i, row in enumerate(x)], "leaf long, id long, vec array<float>")
    key = lambda df: sorted((r["leaf"] is None, r["leaf"] or 0, r["p"], r["rank"], r["c"], r["d2"]) for r in df.collect())
    assert key(knn.group_neighbours(v, 4, block=12)) == key(knn.group_neighbours(v, 4))
    line = spark.range(3600).select(F.lit(1).alias("leaf"), "id", F.array(F.col("id").cast("float")).alias("vec"))
    got = {(r["p"], r["rank"]): r["c"] for r in knn.group_neighbours(line, 2).collect()}
    assert len(got) == 7200 and all({got[i, 1], got[i, 2]} == {i - 1, i + 1} for i in range(1, 3599))


def test_robust_select_against_plain_loops():
    r = np.random.default_rng(6)
    for n in (1, 5, 30):
        x = {i: r.normal(size=6).astype(np.float32) for i in range(n + 1)}
        x[1] = x[n]  # a copy
        d = lambda a, b: float(((x[a].astype(float) - x[b].astype(float)) ** 2).sum())  # noqa: B023, E731
        pool = [(i, d(0, i)) for i in range(1, n + 1)]
        want = []
        for alpha in (1.0, 1.2):
            for c, _ in sorted(pool, key=lambda e: (e[1], e[0])):
                if len(want) < 4 and c not in want and all(d(c, o) and d(0, c) / d(c, o) <= alpha for o in want):
                    want.append(c)
        assert reduce.robust_select(0, pool, x, 4, saturate=False) == want


def test_adjacency_keeps_empty_rows(spark):
    kept = spark.createDataFrame([(1, 2, 1)], "p long, c long, rank int")
    got = {r["id"]: r["nbrs"] for r in reduce.adjacency(kept, spark.range(1, 4)).collect()}
    assert got == {1: [2], 2: [], 3: []}


def test_witnesses_of_large_leaves(spark, monkeypatch):
    """Leaves whose vectors are fetched for pairs give the same witnesses as those that hold them."""
    r = np.random.default_rng(3)
    rows = [(i % 3 if i % 3 else None, i, r.normal(size=5).astype(np.float32).tolist()) for i in range(90)]
    members = spark.createDataFrame(rows, "leaf long, id long, vec array<float>")
    near = knn.group_neighbours(members, 5)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    small = key(reduce.lune_witnesses(near, members))
    monkeypatch.setattr(reduce, "LEAF_ROWS", 20)
    assert small and key(reduce.lune_witnesses(near, members)) == small


def test_partition_tries_again_and_cuts_along_leaders(spark):
    """Data full of copies divides at the root; leaves over the cap are cut into clusters, copies of one vector by ids."""
    p = BuildParams(c_min=8, c_max=64, psamp=0.02, leaf_knn=4, l_max=16, max_degree=16, fanout_top=1, fanout_second=1, max_leaders=64)
    r = np.random.default_rng(1)
    copies = [(i, [0.0, 0.0]) for i in range(560)] + [(560 + i, (r.normal(size=2) + 50).tolist()) for i in range(80)]
    v = spark.createDataFrame(copies, "id long, vec array<float>")
    leaves = partition(v, p)
    assert leaves.where("depth = 0").isEmpty() and leaves.select("id").distinct().count() == len(copies)

    spots = [(i, [float(i % 10) * 100, float(i)]) for i in range(200)]
    v = spark.createDataFrame(spots, "id long, vec array<float>")
    one = v.select(F.lit("x").alias("leaf"), F.lit(2).alias("depth"), F.lit("max_depth").alias("reason"), "id")
    cut = split_large(one, v, replace(p, c_min=2), 40).collect()
    sizes = {}
    for row in cut:
        sizes.setdefault(row["leaf"], []).append(row["id"])
    assert sorted(i for ids in sizes.values() for i in ids) == list(range(200)) and max(map(len, sizes.values())) <= 40
    assert sum(len({i % 10 for i in ids}) for ids in sizes.values()) < 5 * len(sizes)  # clusters, not runs of ids
    same = spark.createDataFrame([(i, [1.0]) for i in range(100)], "id long, vec array<float>")
    cut = split_large(same.select(F.lit("x").alias("leaf"), F.lit(2).alias("depth"), F.lit("max_depth").alias("reason"), "id"), same, p, 40)
    assert sorted(r["count"] for r in cut.groupBy("leaf").count().collect()) == [33, 33, 34]


def test_kept_partition_is_never_overwritten(spark, tmp_path):
    p = BuildParams(c_min=8, c_max=64, psamp=0.05, leaf_knn=4, l_max=16, max_degree=16, fanout_top=2, fanout_second=1, max_leaders=64)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, vec array<float>")
    n = reuse.load_or_build(v, p, str(tmp_path / "kept")).count()
    with pytest.raises(ValueError):
        reuse.load_or_build(v, replace(p, c_max=32), str(tmp_path / "kept"))
    assert reuse.load_or_build(v, p, str(tmp_path / "kept")).count() == n
