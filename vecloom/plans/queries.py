"""The queries of the graph engine over the driver's tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.hashing import fixed_hyperplanes
from ..operators import knn, reduce, report, sampling, search, stats
from ..operators.partition import partition
from ..params import BuildParams, leader_share
from ..runtime import delete_at_end, fresh_path, stored
from ..sources import binary
from .build import build

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Small leaves, so that a few hundred vectors are partitioned at all.
SMALL = BuildParams(c_min=8, c_max=64, psamp=0.05, leaf_knn=4, l_max=16, max_degree=16, fanout_top=4, fanout_second=2, max_leaders=64)
LEAVES, KNN, L_MAX, PLANES = 8, 4, 6, 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = "WITH " + CTES + sql if "WITH" not in sql.split("(")[0] else sql
        return f

    return add


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


_PLANES = f"list_transform(range(0, {PLANES}), lambda i: list_sum(list_transform(range(0, len(vec)), lambda j: CAST(vec[j + 1] AS DOUBLE) * (((i * 31 + j * 17 + i * j * 7) % 101) / 50.0::DOUBLE - 1.0::DOUBLE))))"
_HASH = f"CAST(list_sum(list_transform(range(1, {PLANES + 1}), lambda i: CASE WHEN b.sketch[i] - a.sketch[i] >= 0 THEN 1 << (CAST(i AS INTEGER) - 1) ELSE 0 END)) AS INTEGER)"
_BIT = "CAST(((((((leaf * 2654435761) % 4294967296) << 13) % 4294967296 + (((leaf * 2654435761) % 4294967296) >> 19)) * 2246822507::HUGEINT) % 4294967296) % 64 AS INTEGER)"

#: Common steps of the checks: vectors, leaders, leaves, neighbours, edges, sketches, candidates.
CTES = f"""v AS (SELECT vec_id AS id, embedding AS vec, label FROM embeddings),
leaders AS (SELECT * FROM v WHERE id % 37 = 0),
assigned AS (SELECT * FROM (SELECT v.id, l.id AS leader, {_d2("v.vec", "l.vec")} AS d2, row_number() OVER (PARTITION BY v.id ORDER BY {_d2("v.vec", "l.vec")}, l.id) AS rank FROM v, leaders l) WHERE rank <= 3),
nn AS MATERIALIZED (SELECT * FROM (SELECT leaf, p, c, CAST(row_number() OVER (PARTITION BY p ORDER BY d2, c) AS INTEGER) AS rank, d2 FROM (
  SELECT a.id % {LEAVES} AS leaf, a.id AS p, b.id AS c, {_d2("a.vec", "b.vec")} AS d2 FROM v a JOIN v b ON a.id % {LEAVES} = b.id % {LEAVES} AND a.id <> b.id)) WHERE rank <= {KNN}),
nl AS MATERIALIZED (SELECT * FROM (SELECT leaf, p, c, CAST(row_number() OVER (PARTITION BY p ORDER BY d2, c) AS INTEGER) AS rank, d2 FROM (
  SELECT a.label + 100 AS leaf, a.id AS p, b.id AS c, {_d2("a.vec", "b.vec")} AS d2 FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id)) WHERE rank <= {KNN}),
neighbours AS (SELECT * FROM nn UNION ALL SELECT * FROM nl),
e AS (SELECT leaf, p, c, rank, d2, true AS direct FROM neighbours UNION ALL SELECT leaf, c, p, rank, d2, false FROM neighbours),
sk AS (SELECT id, {_PLANES} AS sketch FROM v),
cand AS (SELECT leaf, p, c, rank, d2, direct, {_HASH} AS hash FROM e JOIN sk a ON e.p = a.id JOIN sk b ON e.c = b.id),
targets AS (SELECT p, c, min(d2) AS d2, min(hash) AS hash FROM cand GROUP BY p, c),
kept AS (SELECT * FROM (SELECT p, c, hash, d2, CAST(row_number() OVER (PARTITION BY p ORDER BY d2, c) AS INTEGER) AS rank FROM targets) WHERE rank <= {L_MAX}),
views AS (SELECT p, c, {_BIT} AS view, min(d2) AS d2, min(CASE WHEN direct THEN greatest(rank, 1) END) AS rank, max(CASE WHEN direct THEN 0 ELSE 1 END) AS mirror FROM e GROUP BY p, c, {_BIT}),
support AS (SELECT p, c, min(d2) AS d2, count(rank) AS family_support, CAST(sum(mirror) AS BIGINT) AS reciprocal_support,
  CAST(coalesce(sum(CASE WHEN rank IS NULL THEN 0 WHEN rank <= 1 THEN 6 WHEN rank = 2 THEN 3 WHEN rank = 3 THEN 2 ELSE 1 END), 0) AS BIGINT) AS rank_mass, CAST(coalesce(min(rank), 255) AS INTEGER) AS best_rank FROM views GROUP BY p, c),
wide AS (SELECT * FROM (SELECT p, c, d2, CAST(row_number() OVER (PARTITION BY p ORDER BY d2, c) AS INTEGER) AS rank FROM (SELECT p, c, min(d2) AS d2 FROM e GROUP BY p, c)) WHERE rank <= 8),
wit AS (SELECT leaf, src, "pivot", victim, CAST(floor(CASE WHEN sv / 1.2::DOUBLE > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (sv / 1.2::DOUBLE - pv) / (sv / 1.2::DOUBLE))) ELSE 0.0::DOUBLE END * 65535 + 0.5::DOUBLE) AS INTEGER) AS margin, pivot_rank, victim_rank
  FROM (SELECT a.leaf, a.p AS src, a.c AS "pivot", b.c AS victim, a.rank AS pivot_rank, b.rank AS victim_rank, b.d2 AS sv, {_d2("x.vec", "y.vec")} AS pv FROM neighbours a JOIN neighbours b ON a.leaf = b.leaf AND a.p = b.p AND a.rank < b.rank JOIN v x ON x.id = a.c JOIN v y ON y.id = b.c)
  WHERE pv < sv / 1.2::DOUBLE),
keep_w AS (SELECT * FROM (SELECT src, victim, "pivot", key, CAST(row_number() OVER (PARTITION BY src, victim ORDER BY key, "pivot") AS INTEGER) AS place FROM (SELECT w.src, w.victim, w."pivot", min(pivot_rank::BIGINT * 16777216 + (65535 - margin) * 256 + victim_rank) AS key
  FROM wit w JOIN wide a ON a.p = w.src AND a.c = w.victim JOIN wide b ON b.p = w.src AND b.c = w."pivot" GROUP BY ALL)) WHERE place <= 2)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.as_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _leaders(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % 37 == 0)


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in two overlapping families of leaves: id modulo LEAVES, and label."""
    v = _labelled(spark, sf_dir)
    a = knn.group_neighbours(v.select((F.col("id") % LEAVES).alias("leaf"), "id", "vec"), KNN)
    b = knn.group_neighbours(v.select((F.col("label") + 100).cast("long").alias("leaf"), "id", "vec"), KNN)
    return a.unionByName(b)


def _witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _labelled(spark, sf_dir)
    families = v.select((F.col("id") % LEAVES).alias("leaf"), "id", "vec").unionByName(v.select((F.col("label") + 100).cast("long").alias("leaf"), "id", "vec"))
    return reduce.lune_witnesses(_neighbours(spark, sf_dir), families)


def _sketches(v: DataFrame) -> DataFrame:
    return v.select("id", V.sketch("vec", fixed_hyperplanes(64, PLANES).tolist()).alias("sketch"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = knn.edges(_neighbours(spark, sf_dir))
    return knn.with_hash(edge, _sketches(vectors(spark, sf_dir)), V.residual_hash("_sp", "_sc"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.lune_candidates(knn.edges(_neighbours(spark, sf_dir)), 8)


def _pairs(v: DataFrame) -> DataFrame:
    """Every point with each of its three nearest leaders."""
    return knn.assign(v, _leaders(v), 3)


def _asked(v: DataFrame) -> DataFrame:
    """The query set: it grows with the table."""
    return v.where("id % 100 = 0")


def _searched(v: DataFrame, width: int) -> DataFrame:
    """The ten nearest of every hundredth vector by a built graph; `width` is the least, more is fitted on a sample."""
    g = build(v, SMALL)
    entries = search.entries(g.nodes, g.start)
    fitted = search.fitted_width(g.nodes, v, width, 10, g.start, entries)
    return search.beam_search(_asked(v), g.nodes, v, [fitted], 10, g.start, entries=entries)


def _shades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wide = _wide(spark, sf_dir)
    return wide, reduce.lune_retained(_witnesses(spark, sf_dir), wide, 2)


@query(f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, id, d2 FROM (SELECT q.id AS query_id, b.id, {_d2("q.vec", "b.vec")} AS d2,
  row_number() OVER (PARTITION BY q.id ORDER BY {_d2("q.vec", "b.vec")}, b.id) AS rank FROM v q, v b WHERE q.id % 100 = 0) WHERE rank <= 10""".join((" ", "")))
def knn_exact_top10(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.nearest(_asked(v), v, 10)


ORACLES["knn_exact_sql"] = ORACLES["knn_exact_top10"]


@query()
def knn_exact_sql(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.nearest_sql(_asked(v), v, 10)


@query(f"SELECT a.id AS a, b.id AS b, {_d2('a.vec', 'b.vec')} AS d2 FROM assigned l JOIN v a ON a.id = l.id JOIN v b ON b.id = l.leader")
def l2_pairs(spark, sf_dir):
    """Distances of every point to its leaders, by ids."""
    v = vectors(spark, sf_dir)
    return knn.distances_by_id(_pairs(v).select(F.col("id").alias("a"), F.col("leader").alias("b")), v).select("a", "b", "d2")


@query(f"SELECT a.id AS a, b.id AS b, {_dot('a.vec', 'b.vec')} AS product FROM assigned l JOIN v a ON a.id = l.id JOIN v b ON b.id = l.leader")
def dot_pairs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    a, b = v.select(F.col("id").alias("a"), F.col("vec").alias("x")), v.select(F.col("id").alias("b"), F.col("vec").alias("y"))
    return _pairs(v).select(F.col("id").alias("a"), F.col("leader").alias("b")).join(a, "a").join(b, "b").select("a", "b", V.dot("x", "y").alias("product"))


@query(f"SELECT id, {_dot('vec', 'vec')} AS norm2 FROM v")
def vec_norms(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", V.squared_norm("vec").alias("norm2"))


@query("SELECT a.id, l.leader, list_transform(list_zip(a.vec, b.vec), lambda p: CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) AS residual FROM assigned l JOIN v a ON a.id = l.id JOIN v b ON b.id = l.leader WHERE l.rank = 1")
def residuals(spark, sf_dir):
    v = vectors(spark, sf_dir)
    near = knn.assign(v, _leaders(v), 1)
    return near.join(v, "id").join(v.select(F.col("id").alias("leader"), F.col("vec").alias("centre")), "leader").select("id", "leader", V.residual("vec", "centre").alias("residual"))


@query("SELECT id, sketch FROM sk")
def sketch_project(spark, sf_dir):
    return _sketches(vectors(spark, sf_dir))


@query(f"SELECT a.id AS p, b.id AS c, {_HASH} AS hash FROM assigned l JOIN sk a ON a.id = l.id JOIN sk b ON b.id = l.leader")
def residual_hash(spark, sf_dir):
    v = vectors(spark, sf_dir)
    pairs = _pairs(v).select(F.col("id").alias("p"), F.col("leader").alias("c"))
    return knn.with_hash(pairs, _sketches(v), V.residual_hash("_sp", "_sc")).select("p", "c", "hash")


@query("SELECT CAST(g AS BIGINT) AS visited, CASE WHEN g <= 0 OR g >= 64 THEN 1.0::DOUBLE ELSE g / 64.0::DOUBLE * (1.0::DOUBLE + 1.75::DOUBLE / sqrt(g::DOUBLE)) * (1.0::DOUBLE + 1.75::DOUBLE / sqrt(g::DOUBLE)) END AS ratio FROM range(0, 65, 8) AS t(g)")
def ads_ratio(spark, sf_dir):
    return spark.range(0, 65, 8).select(F.col("id").alias("visited"), V.pruning_ratio("id", 64, 1.75).alias("ratio"))


@query("SELECT axis, round(avg(x), 6) AS mean FROM (SELECT unnest(range(0, len(vec))) AS axis, unnest(list_transform(vec, lambda x: CAST(x AS DOUBLE))) AS x FROM v) GROUP BY axis")
def centroid(spark, sf_dir):
    mean = stats.centroid(vectors(spark, sf_dir)).select(F.posexplode("centroid").alias("axis", "m"))
    return mean.select(F.col("axis").cast("long").alias("axis"), F.round("m", 6).alias("mean"))


_MEAN = "m AS (SELECT list(x ORDER BY axis) AS c FROM (SELECT axis, avg(x) AS x FROM (SELECT unnest(range(0, len(vec))) AS axis, unnest(list_transform(vec, lambda x: CAST(x AS DOUBLE))) AS x FROM v) GROUP BY axis))"


@query(f", {_MEAN} SELECT id, round(d2, 6) AS d2 FROM (SELECT id, {_d2('vec', 'c')} AS d2 FROM v, m) ORDER BY d2, id LIMIT 1")
def medoid(spark, sf_dir):
    return stats.medoid(vectors(spark, sf_dir)).select("id", F.round("d2", 6).alias("d2"))


@query(f", {_MEAN} SELECT id, round(d2, 6) AS d2 FROM (SELECT id, {_d2('vec', 'c')} AS d2 FROM v, m WHERE id % CAST(ceil((SELECT count(*) FROM v) / 64.0) AS BIGINT) = 0) ORDER BY d2, id LIMIT 1")
def sampled_medoid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return stats.sampled_medoid(v, v.count(), 64).select("id", F.round("d2", 6).alias("d2"))


@query(f""", lc AS (SELECT label, list(x ORDER BY axis) AS c FROM (SELECT label, axis, avg(x) AS x FROM (SELECT label, unnest(range(0, len(vec))) AS axis, unnest(list_transform(vec, lambda x: CAST(x AS DOUBLE))) AS x FROM v) GROUP BY label, axis) GROUP BY label)
SELECT id, centre FROM (SELECT v.id, lc.label::BIGINT AS centre, row_number() OVER (PARTITION BY v.id ORDER BY {_d2('v.vec', 'lc.c')}, lc.label) AS r FROM v, lc) WHERE r = 1""")
def nearest_centroid_assign(spark, sf_dir):
    v = _labelled(spark, sf_dir)
    centres = stats.centroid(v, "label").select(F.col("label").cast("long").alias("centre"), "centroid")
    best = F.row_number().over(Window.partitionBy("id").orderBy("d2", "centre"))  # one centre for each label
    return v.crossJoin(F.broadcast(centres)).select("id", "centre", V.squared_l2("vec", "centroid").alias("d2")).withColumn("r", best).where("r = 1").select("id", "centre")


@query("""WITH g AS (SELECT * FROM (VALUES (10000::BIGINT), (200000), (2000000), (7000000), (15000000), (30000000)) AS t(size), (VALUES (0), (1), (3), (5)) AS u(depth))
SELECT size, depth, round(least(greatest(0.001::DOUBLE * CASE WHEN size >= 20000000 THEN 0.05 WHEN size >= 10000000 THEN 0.1 WHEN size >= 5000000 THEN 0.2 WHEN size >= 1000000 THEN 0.4 WHEN size >= 100000 THEN 0.7 ELSE 1 END::DOUBLE
  * CASE WHEN depth > 4 THEN 0.35 WHEN depth > 2 THEN 0.5 WHEN depth > 0 THEN 0.8 ELSE 1 END::DOUBLE, 0.00005::DOUBLE), 0.1::DOUBLE), 9) AS share,
  CAST(CASE WHEN size >= 5000000 THEN 4096 ELSE 2048 END AS INTEGER) AS size_limit, CAST(CASE depth WHEN 0 THEN 10 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS fanout FROM g""")
def adaptive_params(spark, sf_dir):
    p = BuildParams()
    rows = [(n, d, round(leader_share(p.psamp, n, d), 9), p.size_limit(n), p.fanout(d)) for n in (10_000, 200_000, 2_000_000, 7_000_000, 15_000_000, 30_000_000) for d in (0, 1, 3, 5)]
    return spark.createDataFrame(rows, "size long, depth int, share double, size_limit int, fanout int")


@query("SELECT id, CAST(rank AS INTEGER) AS rank, leader, d2 FROM assigned WHERE rank = 1")
def leader_assign_fanout1(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.assign(v, _leaders(v), 1)


@query("SELECT id, CAST(rank AS INTEGER) AS rank, leader, d2 FROM assigned")
def leader_assign_fanout_k(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.assign(v, _leaders(v), 3)


ORACLES["ads_assign"] = ORACLES["leader_assign_fanout_k"]


@query()
def ads_assign(spark, sf_dir):
    """Early abandoning with a conservative epsilon finds the exact leaders."""
    v = vectors(spark, sf_dir)
    return knn.assign(v, _leaders(v), 3, epsilon=50.0, group=16)


@query("SELECT leader, count(*) AS points, min(d2) AS nearest, max(d2) AS farthest FROM assigned GROUP BY leader")
def assignment_histogram(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return stats.assignment_histogram(knn.assign(v, _leaders(v), 3))


@query("SELECT fanout, count(*) AS points FROM (SELECT id, count(*) AS fanout FROM assigned GROUP BY id) GROUP BY fanout")
def root_fanout_profile(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return stats.fanout_profile(knn.assign(v, _leaders(v), 3))


@query("SELECT count(*) AS places, count(DISTINCT id) AS points, count(*)::DOUBLE / count(DISTINCT id) AS ratio FROM assigned")
def overlap_ratio(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return stats.overlap_ratio(knn.assign(v, _leaders(v), 3))


@query("SELECT CAST(CASE WHEN n >= 128 THEN 128 WHEN n >= 64 THEN 64 WHEN n >= 32 THEN 32 WHEN n >= 16 THEN 16 ELSE 0 END AS INTEGER) AS bucket, count(*) AS leaves, CAST(sum(n) AS BIGINT) AS points FROM (SELECT leader, count(*) AS n FROM assigned GROUP BY leader) GROUP BY 1")
def leaf_size_buckets(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return stats.leaf_sizes(knn.assign(v, _leaders(v), 3).select(F.col("leader").alias("leaf"), "id"), (16, 32, 64, 128))


@query("SELECT leaf, p, c, rank, d2 FROM neighbours")
def leaf_knn(spark, sf_dir):
    return _neighbours(spark, sf_dir)


@query("SELECT leaf, p, c, rank, d2, direct FROM e")
def directed_edges(spark, sf_dir):
    return knn.edges(_neighbours(spark, sf_dir))


@query("SELECT leaf, p, c, rank, d2, direct, hash FROM cand")
def candidate_edges(spark, sf_dir):
    return _candidates(spark, sf_dir).select("leaf", "p", "c", "rank", "d2", "direct", "hash")


@query("SELECT p, c, hash, d2 FROM targets")
def hashprune_dedup(spark, sf_dir):
    return reduce.distinct_targets(_candidates(spark, sf_dir))


@query("SELECT p, c, hash, d2, rank FROM kept")
def hashprune_nearest(spark, sf_dir):
    return reduce.prune_nearest(_candidates(spark, sf_dir), L_MAX)


@query(f"SELECT p, c, hash, d2, rank FROM (SELECT p, c, hash, d2, CAST(row_number() OVER (PARTITION BY p ORDER BY d2, c) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p, hash ORDER BY d2, c) AS r FROM targets) WHERE r = 1) WHERE rank <= {L_MAX}")
def hashprune_bucket(spark, sf_dir):
    return reduce.prune_bucket(_candidates(spark, sf_dir), L_MAX)


@query()
def hashprune_ordered(spark, sf_dir):
    return reduce.prune_ordered(_candidates(spark, sf_dir), L_MAX)


@query("SELECT p, c, hash, d2, CAST(row_number() OVER (PARTITION BY p ORDER BY hash, c) AS INTEGER) AS rank FROM targets")
def hashprune_ordered_whole(spark, sf_dir):
    """Without overflow the ordered rule keeps every distinct target."""
    return reduce.prune_ordered(_candidates(spark, sf_dir), 1000)


@query("SELECT v.id, coalesce(list(c ORDER BY rank) FILTER (c IS NOT NULL), []) AS nbrs FROM v LEFT JOIN kept ON p = v.id GROUP BY v.id")
def adjacency_rows(spark, sf_dir):
    return reduce.adjacency(reduce.prune_nearest(_candidates(spark, sf_dir), L_MAX), vectors(spark, sf_dir))


@query("SELECT p, c, d2, family_support, reciprocal_support, rank_mass, best_rank FROM support")
def spine_support(spark, sf_dir):
    return reduce.overlay_support(knn.edges(_neighbours(spark, sf_dir)))


@query("SELECT p, c, CAST(row_number() OVER (PARTITION BY p ORDER BY family_support DESC, reciprocal_support DESC, rank_mass DESC, best_rank, d2, c) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY family_support DESC, rank_mass DESC, best_rank, reciprocal_support DESC, d2, c) AS slot FROM support) WHERE slot <= 6")
def spine_ranked(spark, sf_dir):
    support = reduce.overlay_support(knn.edges(_neighbours(spark, sf_dir)))
    return reduce.overlay_ranked(reduce.overlay_retained(support, 6), 6).select("p", "c", "place")


@query("""SELECT p, list(c ORDER BY o, n) AS nbrs FROM (SELECT p, c, o, n, row_number() OVER (PARTITION BY p ORDER BY o, n) AS k FROM (
  SELECT p, c, min(o) AS o, min_by(n, o) AS n FROM (
    SELECT p, c, CASE WHEN b <= 4 THEN 0 ELSE 2 END AS o, b AS n FROM bs UNION ALL SELECT p, c, 1, n FROM ov) GROUP BY p, c)) WHERE k <= 6 GROUP BY p""".replace("SELECT p, list", """, bs AS (SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY hash, c) AS b FROM kept),
rk AS (SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY family_support DESC, reciprocal_support DESC, rank_mass DESC, best_rank, d2, c) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY family_support DESC, rank_mass DESC, best_rank, reciprocal_support DESC, d2, c) AS slot FROM support) WHERE slot <= 6),
ov AS (SELECT p, c, n FROM (SELECT rk.p, rk.c, row_number() OVER (PARTITION BY rk.p ORDER BY place) AS n FROM rk LEFT JOIN bs ON bs.p = rk.p AND bs.c = rk.c AND b <= 4 WHERE bs.p IS NULL) WHERE n <= 2)
SELECT p, list""", 1))
def spine_overlay(spark, sf_dir):
    kept = reduce.prune_nearest(_candidates(spark, sf_dir), L_MAX)
    ranked = reduce.overlay_ranked(reduce.overlay_retained(reduce.overlay_support(knn.edges(_neighbours(spark, sf_dir))), 6), 6)
    return reduce.overlay_select(kept, ranked, 6, 2)


@query("SELECT p, c, d2, rank FROM wide")
def lune_candidates_topw(spark, sf_dir):
    return _wide(spark, sf_dir)


@query("SELECT leaf, src, \"pivot\", victim, margin, pivot_rank, victim_rank FROM wit")
def lune_witnesses(spark, sf_dir):
    return _witnesses(spark, sf_dir)


@query("SELECT src, victim, \"pivot\", key, place FROM keep_w")
def lune_witness_retention(spark, sf_dir):
    return _shades(spark, sf_dir)[1].select("src", "victim", "pivot", "key", "place")


_LUNE = """, lr AS (SELECT p, list(c ORDER BY d2, c) AS cands FROM wide GROUP BY p),
sh AS (SELECT p, map_from_entries(list((victim, pv))) AS m FROM (SELECT src AS p, victim, list("pivot") AS pv FROM keep_w GROUP BY src, victim) GROUP BY p),
lf AS (SELECT lr.p, cands, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(cands, lambda c: [c])),
  lambda acc, x: CASE WHEN len(acc) >= 5 THEN acc WHEN len(acc) >= 1 AND coalesce(list_has_any(m[x[1]], acc), false) THEN acc ELSE list_append(acc, x[1]) END) AS take FROM lr LEFT JOIN sh ON lr.p = sh.p),
ls AS (SELECT p, CASE WHEN len(cands) <= 5 THEN cands ELSE list_slice(list_concat(take, list_filter(cands, lambda c: NOT list_contains(take, c))), 1, 5) END AS nbrs,
  CAST(CASE WHEN len(cands) <= 5 THEN 0 WHEN len(take) = 5 THEN list_position(cands, take[5]) - 5 ELSE len(cands) - len(take) END AS BIGINT) AS skipped,
  CAST(CASE WHEN len(cands) <= 5 THEN 0 ELSE least(5, len(cands)) - len(take) END AS BIGINT) AS filled FROM lf) """


@query(_LUNE + "SELECT p, nbrs, skipped, filled FROM ls")
def view_lune_select(spark, sf_dir):
    wide, kept = _shades(spark, sf_dir)
    return reduce.lune_select(reduce.lune_rows(wide, kept), 5, 1)


@query(_LUNE + """SELECT (SELECT count(DISTINCT p) FROM wide) AS sources, (SELECT count(*) FROM wide) AS candidates, (SELECT count(*) FROM keep_w) AS witnesses, (SELECT count(*) FROM (SELECT DISTINCT src, victim FROM keep_w)) AS victims,
  CAST(sum(len(nbrs)) AS BIGINT) AS edges, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(filled) AS BIGINT) AS filled FROM ls""")
def view_lune_stats(spark, sf_dir):
    wide, kept = _shades(spark, sf_dir)
    return report.selection(wide, kept, reduce.lune_select(reduce.lune_rows(wide, kept), 5, 1))


@query("""SELECT count(*) AS rows, CAST(sum(CASE WHEN a.n = b.n THEN 1 ELSE 0 END) AS BIGINT) AS same, CAST(sum(len(list_intersect(a.n, b.n))) AS BIGINT) AS shared, CAST(sum(len(b.n)) AS BIGINT) AS edges
FROM (SELECT p, list(c ORDER BY rank) AS n FROM kept WHERE rank <= 4 GROUP BY p) a JOIN (SELECT p, list(c ORDER BY rank) AS n FROM wide GROUP BY p) b ON a.p = b.p""")
def graph_overlap(spark, sf_dir):
    a = reduce.prune_nearest(_candidates(spark, sf_dir), 4)
    ids = vectors(spark, sf_dir)
    return report.overlap(reduce.adjacency(a, ids), reduce.adjacency(_wide(spark, sf_dir), ids))


@query("SELECT leader, count(*) AS points, list(id ORDER BY id) AS ids FROM assigned WHERE rank = 1 GROUP BY leader")
def closest_centres(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return report.inverted_index(knn.assign(v, _leaders(v), 1))


@query("SELECT count(*) AS rows, count(*) AS hits FROM nl")
def ads_leaf_agreement(spark, sf_dir):
    """Early abandoning with a conservative epsilon agrees with exact neighbours in every leaf."""
    v = _labelled(spark, sf_dir).select(F.col("label").alias("leaf"), "id", "vec")
    return report.agreement(knn.group_neighbours(v, KNN, epsilon=50.0, group=16, pruned_from=2), knn.group_neighbours(v, KNN), ("p", "c", "rank"))


_ROBUST = f""", rp AS (SELECT a.p, b.c AS victim, a.c AS "by", b.d2 / nullif({_d2("x.vec", "y.vec")}, 0) AS ratio FROM kept a JOIN kept b ON a.p = b.p AND a.c <> b.c JOIN v x ON x.id = a.c JOIN v y ON y.id = b.c),
rs AS (SELECT p, map_from_entries(list((victim, one))) AS one, map_from_entries(list((victim, two))) AS two FROM (
  SELECT p, victim, list("by") FILTER (ratio IS NULL OR ratio > 1.0::DOUBLE) AS one, list("by") FILTER (ratio IS NULL OR ratio > 1.2::DOUBLE) AS two FROM rp GROUP BY p, victim) GROUP BY p),
rc AS (SELECT p, list(c ORDER BY d2, c) AS cands FROM kept GROUP BY p),
r1 AS (SELECT rc.p, cands, two, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(cands, lambda c: [c])),
  lambda acc, x: CASE WHEN len(acc) >= 4 THEN acc WHEN coalesce(list_has_any(one[x[1]], acc), false) THEN acc ELSE list_append(acc, x[1]) END) AS t FROM rc LEFT JOIN rs ON rc.p = rs.p),
r2 AS (SELECT p, cands, list_reduce(list_prepend(t, list_transform(cands, lambda c: [c])),
  lambda acc, x: CASE WHEN len(acc) >= 4 OR list_contains(acc, x[1]) THEN acc WHEN coalesce(list_has_any(two[x[1]], acc), false) THEN acc ELSE list_append(acc, x[1]) END) AS t FROM r1)
SELECT p, list_slice(list_concat(t, list_filter(cands, lambda c: NOT list_contains(t, c))), 1, 4) AS nbrs FROM r2"""


@query(_ROBUST)
def robust_prune(spark, sf_dir):
    kept = reduce.prune_nearest(_candidates(spark, sf_dir), L_MAX)
    return reduce.prune_robust(kept, vectors(spark, sf_dir), 4)


@query("SELECT count(*) AS nodes, CAST(sum(n) AS BIGINT) AS edges, CAST(min(n) AS INTEGER) AS smallest, CAST(max(n) AS INTEGER) AS largest, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM (SELECT v.id, count(c) AS n FROM v LEFT JOIN kept ON p = v.id GROUP BY v.id)")
def degree_stats(spark, sf_dir):
    return stats.degrees(reduce.adjacency(reduce.prune_nearest(_candidates(spark, sf_dir), L_MAX), vectors(spark, sf_dir)))


def _times(x: str, factor: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"


@query(f"""WITH a AS (SELECT vec_id AS id, xor(17::UBIGINT, {_times("vec_id", 0x9E3779B97F4A7C15)}) AS x FROM embeddings),
b AS (SELECT id, CAST((CAST(x AS UHUGEINT) + {0x9E3779B97F4A7C15}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM a),
c AS (SELECT id, {_times("xor(z, z >> 30)", 0xBF58476D1CE4E5B9)} AS z FROM b), d AS (SELECT id, {_times("xor(z, z >> 27)", 0x94D049BB133111EB)} AS z FROM c)
SELECT id, CAST(place AS INTEGER) AS place FROM (SELECT id, row_number() OVER (ORDER BY xor(z, z >> 31), id) AS place FROM d) WHERE place <= 32""")
def bottomk_leaders(spark, sf_dir):
    return sampling.bottom_k(vectors(spark, sf_dir), 32, 17)


@query()
def rbc_leaves(spark, sf_dir):
    return partition(vectors(spark, sf_dir), SMALL)


@query()
def rbc_stats(spark, sf_dir):
    return stats.partition_stats(partition(vectors(spark, sf_dir), SMALL))


@query("SELECT count(DISTINCT id) AS points, true AS covers FROM v")
def rbc_covers(spark, sf_dir):
    """Leaves hold every id, none is larger than the cap."""
    leaves = partition(vectors(spark, sf_dir), SMALL)
    largest = leaves.groupBy("leaf").count().agg(F.max("count").alias("m"))
    return leaves.agg(F.countDistinct("id").alias("points")).crossJoin(F.broadcast(largest)).select("points", (F.col("m") <= SMALL.leaf_cap).alias("covers"))  # one row each


@query()
def build_graph(spark, sf_dir):
    return build(vectors(spark, sf_dir), SMALL).nodes


@query()
def build_graph_lune(spark, sf_dir):
    from dataclasses import replace

    return build(vectors(spark, sf_dir), replace(SMALL, final_prune="lune")).nodes


@query()
def beam_search(spark, sf_dir):
    return _searched(vectors(spark, sf_dir), 40)


@query()
def recall_by_width(spark, sf_dir):
    """Recall of the built graph at 10 for several beam widths, against exact search."""
    v = vectors(spark, sf_dir)
    g = build(v, SMALL)
    asked = _asked(v)
    truth = stored(knn.nearest(asked, v, 10), "truth")
    found = stored(search.beam_search(asked, g.nodes, v, [10, 40, 100], 10, g.start, entries=search.entries(g.nodes, g.start)), "found")
    hits = found.join(truth.select("query_id", "id"), ["query_id", "id"]).groupBy("width").agg((F.count(F.lit(1)) / F.lit(asked.count() * 10)).alias("recall"))
    return hits


@query(""", a AS (SELECT q.id AS query_id, b.id, row_number() OVER (PARTITION BY q.id ORDER BY D2, b.id) AS rank FROM v q, v b WHERE q.id % 100 = 0 AND q.id <> b.id),
f AS (SELECT query_id, id FROM (SELECT q.id AS query_id, b.id, row_number() OVER (PARTITION BY q.id ORDER BY D2, b.id) AS rank FROM v q, v b WHERE q.id % 100 = 0 AND q.id <> b.id AND q.label = b.label) WHERE rank <= 10)
SELECT count(DISTINCT a.query_id) AS queries, count(f.id) / (count(DISTINCT a.query_id) * 10.0::DOUBLE) AS recall FROM a LEFT JOIN f ON a.query_id = f.query_id AND a.id = f.id WHERE a.rank <= 10""".replace("D2", _d2("q.vec", "b.vec")))
def recall_at_k(spark, sf_dir):
    """Recall of a search that looks only at the query's own label."""
    v = _labelled(spark, sf_dir)
    near = knn.group_neighbours(v.select(F.col("label").alias("leaf"), "id", "vec"), 10)
    found = near.join(_asked(v).select(F.col("id").alias("p")), "p", "left_semi").select(F.col("p").alias("query_id"), F.col("c").alias("id"), "rank")
    return stats.recall(found, knn.nearest(_asked(v), v, 10, skip_self=True), 10)


@query("SELECT count(*) AS n, max(CASE WHEN i = least(n // 2, n - 1) THEN s END) AS p50, max(CASE WHEN i = least(CAST(floor(n * 0.99::DOUBLE + 0.5) AS BIGINT), n - 1) THEN s END) AS p99 FROM (SELECT CAST(id * 37 % 101 AS DOUBLE) AS s, row_number() OVER (ORDER BY id * 37 % 101) - 1 AS i, count(*) OVER () AS n FROM v)")
def latency_percentiles(spark, sf_dir):
    return stats.latency(vectors(spark, sf_dir).select((F.col("id") * 37 % 101).cast("double").alias("seconds")))


@query("SELECT count(*) AS nodes, 0::BIGINT AS too_long, 0::BIGINT AS loops, 0::BIGINT AS repeats, 0::BIGINT AS strangers FROM v")
def build_graph_sound(spark, sf_dir):
    """A built graph has a row for each vector, of bounded degree, without loops, repeats or unknown ids."""
    v = vectors(spark, sf_dir)
    nodes = build(v, SMALL).nodes
    ends = nodes.select(F.explode("nbrs").alias("id")).join(v, "id", "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    count = lambda c: F.count(F.when(c, 1))
    rows = nodes.agg(F.count(F.lit(1)).alias("nodes"), count(F.size("nbrs") > SMALL.max_degree).alias("too_long"), count(F.array_contains("nbrs", F.col("id"))).alias("loops"), count(F.size(F.array_distinct("nbrs")) < F.size("nbrs")).alias("repeats"))
    return rows.crossJoin(F.broadcast(ends))  # one row each


@query("SELECT count(*) AS queries, true AS ordered, true AS recalled FROM v WHERE id % 100 = 0")
def beam_search_sound(spark, sf_dir):
    """Searches answer every query, with distances that don't fall, and find nine tenths of the exact neighbours."""
    v = vectors(spark, sf_dir)
    found = stored(_searched(v, 100), "found")
    falls = found.withColumn("_d", F.lag("d2").over(Window.partitionBy("query_id").orderBy("rank"))).agg(F.coalesce(F.min(F.col("d2") >= F.col("_d")), F.lit(True)).alias("ordered"))
    recall = stats.recall(found.select("query_id", "id", "rank"), knn.nearest(_asked(v), v, 10), 10)
    return recall.crossJoin(F.broadcast(falls)).select("queries", "ordered", (F.col("recall") >= 0.9).alias("recalled"))  # one row each


def _exported(v: DataFrame, **options) -> str:
    path = fresh_path(v.sparkSession, "matrix")
    binary.write_matrix(v, path, **options)
    delete_at_end(v.sparkSession, path)
    return path


_PLACE = "SELECT row_number() OVER (ORDER BY id) - 1 AS id, vec FROM v"


@query(_PLACE)
def matrix_round_trip(spark, sf_dir):
    """Vectors exported as one matrix file and read by ranges; ids are places in the file."""
    return binary.read_matrix(spark, _exported(vectors(spark, sf_dir)))


@query(f"SELECT id, vec FROM ({_PLACE}) WHERE id < 100")
def matrix_limited(spark, sf_dir):
    """The row limit of the reader is the feature."""
    return binary.read_matrix(spark, _exported(vectors(spark, sf_dir)), limit=100)


@query("SELECT count(*) AS n, max(len(vec))::BIGINT AS columns, 8::BIGINT AS begin FROM v")
def matrix_metadata(spark, sf_dir):
    return spark.createDataFrame([binary.metadata(_exported(vectors(spark, sf_dir)))], "n long, columns long, begin long")


@query(f"SELECT id, vec FROM v UNION ALL SELECT id + (SELECT max(id) + 1 FROM v), vec FROM ({_PLACE})")
def matrix_append(spark, sf_dir):
    """A file's rows are numbered on from the last id."""
    v = vectors(spark, sf_dir)
    return binary.append(v, spark, _exported(v))


@query(_PLACE)
def raw_round_trip(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return binary.read_matrix(spark, _exported(v, layout="raw"), layout="raw", columns=v.agg(F.max(F.size("vec"))).first()[0])


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS id, list_transform(sketch, lambda x: CAST(x AS FLOAT)) AS vec FROM sk")
def sketch_store(spark, sf_dir):
    sketches = _sketches(vectors(spark, sf_dir)).withColumnRenamed("sketch", "vec")
    return binary.read_matrix(spark, _exported(sketches, layout="sketch"), layout="sketch")


@query("SELECT id FROM v WHERE id % 7 <> 0")
def deleted_ids(spark, sf_dir):
    """Vectors without those that a list of deleted ids names."""
    v = vectors(spark, sf_dir)
    gone = _exported(v.where("id % 7 = 0").select("id", F.array("id").alias("vec")), layout="sized", dtype="u32")
    return v.join(binary.read_ids(spark, gone), "id", "left_anti").select("id")


@query(f"""SELECT dense_rank() OVER (ORDER BY query_id) - 1 AS query_id, CAST(rank AS INTEGER) AS rank, id FROM (SELECT q.id AS query_id, b.id,
  row_number() OVER (PARTITION BY q.id ORDER BY {_d2("q.vec", "b.vec")}, b.id) AS rank FROM v q, v b WHERE q.id % 100 = 0) WHERE rank <= 10""")
def result_round_trip(spark, sf_dir):
    """Search results exported as a matrix of ids and read as a ground truth; queries are numbered by their place."""
    path = fresh_path(spark, "results")
    binary.write_results(knn_exact_top10(spark, sf_dir), path, 10)
    delete_at_end(spark, path)
    return binary.read_truth(spark, path, 10)


ORACLES["graph_round_trip"] = ORACLES["adjacency_rows"]


@query()
def graph_round_trip(spark, sf_dir):
    """A neighbour graph exported as one file and read back. Its ids are 0..n-1, as the format has no others."""
    path = fresh_path(spark, "graph")
    n = binary.write_graph(stored(adjacency_rows(spark, sf_dir), "adjacency"), path, 0)
    delete_at_end(spark, path)
    return binary.read_graph(spark, path, n)[0]
