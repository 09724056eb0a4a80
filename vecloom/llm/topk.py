"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are scaled to integers and scores are exact: sums of products below 2**53
are exact as doubles, others are summed again as integers. Each vector is cut into
segments; a segment is summed up by its mean and deviation. By Cauchy-Schwarz
the product of two segments of length L is at most L * (mean * mean + dev *
dev), and |q|^2 + |x|^2 minus twice that sum is the familiar lower bound of
their distance. The bounds go from coarse to fine: most candidates fall at the
first levels, exact products are computed for what is left.

Candidates are packed into blocks; the stated queries are packed into blocks
too and dealt to every group of candidate blocks, a few queries at a time, so
a task holds one block of each. A block pair hands on at most k rows a query,
and the best k are merged by a window with partial limits.

Null, empty, repeated: vectors that are null, empty or hold null or non-finite
components (also once scaled) take no part; scores beyond a long are cut to its
limits and tie there; vectors of another length than the query's are not
compared; equal scores go to the smaller id; a query's own row is left out by
id, so rows that repeat its id are left out too; an empty table gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import bounded_batches

SCALE = 1024
LEVELS = (4, 8, 16)
#: Vectors in a block of candidates and of queries.
BLOCK, QUERY_BLOCK = 4096, 512
#: Vectors in one of the groups that candidate blocks are dealt to; each group gets every query block.
GROUP_ROWS = 1 << 18


def _pack(step: int):
    """Blocks of vectors of one length: (dim, ids as int64 bytes, integer components as float64 bytes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            at = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            length = np.diff(at)
            for dim in np.unique(length[length > 0]).tolist():
                rows = np.flatnonzero(length == dim)
                x = np.floor(flat[at[rows][:, None] + np.arange(dim)] * SCALE)
                for i in range(0, len(rows), step):
                    r = rows[i : i + step]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[r].astype("<i8").tobytes()], pa.binary()), pa.array([x[i : i + step].astype("<f8").tobytes()], pa.binary())], ["dim", "ids", "vectors"])

    return pack


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of `segments` nearly equal parts, weighted so that bounds are plain products."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    width = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / width
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / width
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, dev]) * np.sqrt(np.hstack([width, width]))


def products(x: np.ndarray, q: np.ndarray, norms: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products of integer rows x with q, as int64; norms: lengths of the rows, norm: of q."""
    bound = norms * norm  # no partial sum is larger
    out = np.zeros(len(x), np.int64)
    small, medium = bound <= 2.0**52, bound <= 2.0**61
    out[small] = (x[small] @ q).astype(np.int64)
    rows = np.flatnonzero(medium & ~small)
    if len(rows):
        out[rows] = x[rows].astype(np.int64) @ q.astype(np.int64)
    whole = [int(v) for v in q] if not medium.all() else []
    for i in np.flatnonzero(~medium).tolist():
        out[i] = min(max(sum(a * int(b) for a, b in zip(whole, x[i], strict=True)), -(2**63)), 2**63 - 1)
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, levels=LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of the k best rows for each query, ties to the smaller id, own id left out."""
    with np.errstate(over="ignore", invalid="ignore"):
        stats = [(segment_statistics(q, s), segment_statistics(x, s)) for s in levels if s < x.shape[1]]
        norms = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    out_q, out_r, out_s = [], [], []
    for i in range(len(q)):
        other = np.flatnonzero(ids != q_ids[i])
        if not len(other):
            continue
        bound = norms[0][i] * norms[1][other]
        if not np.isfinite(bound).all():  # too large for bounds
            rows = other
            score = products(x[rows], q[i], norms[1][rows], norms[0][i])
            best = np.lexsort((ids[rows], ~score))[:k]
            out_q.append(np.full(len(best), i))
            out_r.append(rows[best])
            out_s.append(score[best])
            continue
        slack = 1e-9 * (1 + float(bound.max()))
        if stats:
            bound = np.minimum(bound, stats[0][1][other] @ stats[0][0][i])
        # exact scores of the most promising rows set the threshold
        first = other[np.argpartition(-bound, k - 1)[:k]] if len(other) > k else other
        exact = x[first] @ q[i]
        least = np.sort(exact)[-k] if len(exact) >= k else -np.inf
        rows = other[bound >= least - slack]
        for a, b in stats[1:]:
            if len(rows) <= 4 * k:
                break
            rows = rows[b[rows] @ a[i] >= least - slack]
        score = products(x[rows], q[i], norms[1][rows], norms[0][i])
        best = np.lexsort((ids[rows], ~score))[:k]
        out_q.append(np.full(len(best), i))
        out_r.append(rows[best])
        out_s.append(score[best])
    if not out_q:
        z = np.zeros(0, np.int64)
        return z, z, z
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                dim = batch.column(0)[row].as_py()
                q_ids, ids = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i8") for c in (1, 3))
                q, x = (np.frombuffer(batch.column(c)[row].as_buffer(), "<f8").reshape(-1, dim) for c in (2, 4))
                a, b, score = search_block(q_ids, q, ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(ids[b]), pa.array(score)], ["query_id", "vec_id", "score"])

    return search


def valid(vector: str) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * SCALE) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def top_k(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", groups: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where `queries` holds, its k best other rows."""
    bounded_batches(rows.sparkSession)
    vectors = rows.where(F.col(id_col).isNotNull() & valid(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    if groups is None:
        groups = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // GROUP_ROWS))
    kind = "dim int, ids binary, vectors binary"
    x = vectors.select("id", "v").mapInArrow(_pack(BLOCK), kind).select("dim", F.col("ids").alias("x_ids"), F.col("vectors").alias("x"))
    x = x.withColumn("g", F.pmod(F.xxhash64("x_ids"), F.lit(groups)).cast("int"))
    q = vectors.where("q").select("id", "v").mapInArrow(_pack(QUERY_BLOCK), kind).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
    q = q.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # a block pair is CPU work: a task for each group, whatever its bytes
    q, x = q.repartition(groups, "dim", "g"), x.repartition(groups, "dim", "g")
    pairs = q.join(x, ["dim", "g"]).select("dim", "q_ids", "q", "x_ids", "x")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
