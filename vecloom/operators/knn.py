"""Exact nearest neighbours: stated queries against all rows, neighbours within groups, leader assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.vector import squared_l2
from .arrow import batch, matrix

#: Bytes of query or leader vectors that may be broadcast at once.
BROADCAST_BYTES = 64 << 20
#: Rows of a leaf, or of a block of a larger one, that a task compares with as many.
LEAF_ROWS = 3500


def as_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))


def chunks(small: DataFrame, limit: int = BROADCAST_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of a vector table in parts of at most `limit` bytes, so that each may be broadcast."""
    stats = small.select(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    parts = max(1, -(-(stats["n"] * (stats["d"] or 0) * 4) // limit))
    for p in range(parts):
        mine = small if parts == 1 else small.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
        table = mine.select("id", "vec").orderBy("id").toArrow()
        if len(table):
            yield table["id"].to_numpy(), matrix(table["vec"])


def nearest(queries: DataFrame, base: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """query_id, rank, id, d2: the k nearest base rows of each query, ties by id.

    Queries are broadcast in bounded parts; each task keeps k rows of a query for each Arrow batch, the best k of all
    are picked by a window with partial limits. Base rows are never shuffled.
    """
    spark = base.sparkSession
    found = None
    for ids, vectors in chunks(queries):
        shared = spark.sparkContext.broadcast((ids, vectors))

        def search(batches, shared=shared):
            q_ids, q = shared.value
            for part in batches:
                own = part.column(0).to_numpy()
                a, b, d, _ = kernels.top_k(q, matrix(part.column(1)), own, k, q_ids if skip_self else None)
                yield batch(["query_id", "id", "d2"], q_ids[a], own[b], d)

        part = base.select("id", "vec").mapInArrow(search, "query_id long, id long, d2 double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, d2 double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "d2")


def check_bound(small: DataFrame, limit: int = BROADCAST_BYTES) -> None:
    """Refuse a vector table that is too large to broadcast."""
    stats = small.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if stats["n"] * (stats["d"] or 0) * 4 > limit:
        raise ValueError(f"{stats['n']} vectors exceed the bound of a broadcast")


def nearest_sql(queries: DataFrame, base: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """nearest() as plain expressions, for queries of a bounded size and as a check."""
    check_bound(queries)
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    pairs = F.broadcast(q).crossJoin(base) if not skip_self else F.broadcast(q).join(base, F.col("query_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id"))
    return pairs.select("query_id", "id", squared_l2("q", "vec").alias("d2")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "d2")


def assign(points: DataFrame, leaders: DataFrame, fanout: int, epsilon: float | None = None, group: int = 32) -> DataFrame:
    """id, rank, leader, d2: the `fanout` nearest leaders of each point. leaders (id, vec) must fit BROADCAST_BYTES.

    epsilon: abandon far leaders early on a part of the dimensions (approximate).
    """
    if not 1 <= fanout <= 32:
        raise ValueError("fanout must be in 1..32")
    parts = list(chunks(leaders))
    if len(parts) > 1:
        raise ValueError("leaders exceed the bound of a broadcast; sample fewer")
    if not parts:
        return points.sparkSession.createDataFrame([], "id long, rank int, leader long, d2 double")
    shared = points.sparkSession.sparkContext.broadcast(parts[0])

    def pick(batches):
        ids, vectors = shared.value
        for part in batches:
            own, x = part.column(0).to_numpy(), matrix(part.column(1))
            if not len(own):
                continue
            a, b, d, rank = kernels.top_k(x, vectors, ids, fanout) if epsilon is None else kernels.sampled_top_k(x, vectors, ids, fanout, epsilon, group)[0]
            yield batch(["id", "rank", "leader", "d2"], own[a], rank.astype(np.int32), ids[b], d)

    return points.select("id", "vec").mapInArrow(pick, "id long, rank int, leader long, d2 double")


def group_neighbours(members: DataFrame, k: int, cap: int | None = None, epsilon: float | None = None, group: int = 32, pruned_from: int = 513, block: int = LEAF_ROWS) -> DataFrame:
    """leaf, p, c, rank, d2: the k nearest members of each member's leaf. members: leaf, id, vec; ids of a leaf are distinct.

    A leaf of at most `block` rows is one task's work; distances are computed in blocks of rows. The rows of a larger one
    are dealt to blocks, each pair of row block and column block is a task, and the k best by (d2, id) are merged.
    cap: instead, refuse leaves of more rows, for callers that have split theirs.
    epsilon: early abandoning in leaves of `pruned_from` and more rows (in larger leaves: block pairs).
    """
    leaf_type = members.schema["leaf"].dataType.simpleString()
    members = members.select("leaf", "id", "vec")
    out = f"leaf {leaf_type}, p long, c long, rank int, d2 double"

    def best(table, rows, columns):
        """The k nearest of the rows `columns` for each of the rows `rows`."""
        ids = table["id"].to_numpy()
        own, other = (m[np.argsort(ids[m], kind="stable")] for m in (rows, columns))
        if not len(own) or not len(other):
            a, b, d, rank = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        else:
            vec = matrix(table["vec"])
            x, y = vec[own], vec[other]
            if epsilon is not None and len(other) >= pruned_from:
                a, b, d, rank = kernels.sampled_top_k(x, y, ids[other], k, epsilon, group, own=ids[own])[0]
            else:
                a, b, d, rank = kernels.top_k(x, y, ids[other], k, own=ids[own])
        leaf = table["leaf"].combine_chunks().take(pa.array(np.zeros(len(a), np.int64))) if len(a) else table["leaf"].slice(0, 0)
        return pa.table([leaf, pa.array(ids[own][a]), pa.array(ids[other][b]), pa.array(np.asarray(rank, np.int32)), pa.array(d)], ["leaf", "p", "c", "rank", "d2"])

    def neighbours(table):
        if cap is not None and len(table) > cap:
            raise ValueError(f"a leaf has {len(table)} rows, more than {cap}")
        every = np.arange(len(table))
        return best(table, every, every)

    def tile(table):
        return best(table, np.flatnonzero(table["own"].to_numpy(zero_copy_only=False)), np.flatnonzero(~table["own"].to_numpy(zero_copy_only=False)))

    whole = lambda df: df.groupBy("leaf").applyInArrow(neighbours, out)
    if cap is not None:
        return whole(members)
    large = members.groupBy(F.col("leaf").alias("_leaf")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    if large.isEmpty():
        return whole(members)
    same = F.col("leaf").eqNullSafe(F.col("_leaf"))
    dealt = members.join(F.broadcast(large), same).drop("_leaf").withColumn("b", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # a row is asked for in each column block, and is a column for each row block
    place = lambda own: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct((F.col("b") if own else x).alias("i"), (x if own else F.col("b")).alias("j"), F.lit(own).alias("own")))
    tiles = dealt.select("leaf", "id", "vec", F.explode(F.concat(place(True), place(False))).alias("t")).select("leaf", "id", "vec", "t.*")
    found = tiles.groupBy("leaf", "i", "j").applyInArrow(tile, out)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("leaf", "p").orderBy("d2", "c"))).where(F.col("rank") <= k)
    return whole(members.join(F.broadcast(large), same, "left_anti")).unionByName(found.select("leaf", "p", "c", "rank", "d2"))


def edges(neighbours: DataFrame) -> DataFrame:
    """Each neighbour pair both ways: direct p -> c, and its mirror c -> p with the same rank."""
    direct = neighbours.select("leaf", "p", "c", "rank", "d2", F.lit(True).alias("direct"))
    mirror = neighbours.select("leaf", F.col("c").alias("p"), F.col("p").alias("c"), "rank", "d2", F.lit(False).alias("direct"))
    return direct.unionByName(mirror)


def distances_by_id(pairs: DataFrame, vectors: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """pairs with d2, fetching both vectors by id."""
    a = vectors.select(F.col("id").alias(left), F.col("vec").alias("_l"))
    b = vectors.select(F.col("id").alias(right), F.col("vec").alias("_r"))
    return pairs.join(a, left).join(b, right).withColumn("d2", squared_l2("_l", "_r")).drop("_l", "_r")


def with_hash(edge: DataFrame, sketches: DataFrame, hash_column: Column) -> DataFrame:
    """edges with the residual hash of their ends' sketches (id, sketch), seen as _sp and _sc by hash_column."""
    p = sketches.select(F.col("id").alias("p"), F.col("sketch").alias("_sp"))
    c = sketches.select(F.col("id").alias("c"), F.col("sketch").alias("_sc"))
    return edge.join(p, "p").join(c, "c").withColumn("hash", hash_column).drop("_sp", "_sc")
