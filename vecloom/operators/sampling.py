"""Order-free samples: the k ids with the smallest seeded score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import sample_score
from .arrow import batch


def with_score(df: DataFrame, seed: int | str = 42, id_col: str = "id") -> DataFrame:
    """df with score (long): the unsigned score moved so that signed order is its order. seed: a number or a column's name."""
    names = df.columns

    def scored(batches):
        import numpy as np

        for part in batches:
            ids = part.column(names.index(id_col)).to_numpy()
            if isinstance(seed, str):
                from ..functions.hashing import GOLDEN, splitmix64

                seeds = part.column(names.index(seed)).to_numpy().astype(np.int64).view(np.uint64)
                value = splitmix64(seeds ^ (ids.astype(np.uint64) * GOLDEN))
            else:
                value = sample_score(ids, seed)
            yield batch([*names, "score"], *part.columns, (value ^ np.uint64(1 << 63)).view(np.int64))

    return df.mapInArrow(scored, T.StructType([*df.schema.fields, T.StructField("score", T.LongType())]))


def bottom_k(ids: DataFrame, k: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """(id, place): the k distinct ids of smallest score, ties by id; all of them, by id, if there are no more than k."""
    rows = with_score(ids.select(id_col).distinct(), seed, id_col)
    picked = rows.orderBy("score", id_col).limit(max(k, 0))
    order = Window.orderBy("score", id_col)  # at most k rows
    return picked.withColumn("place", F.row_number().over(order)).select(id_col, "place")


def bottom_k_by(groups: DataFrame, group_col: str, k_col: str, seed_col: str, most: int, id_col: str = "id") -> DataFrame:
    """bottom_k in each group, k and seed taken from the rows; `most` bounds every k, so that tasks keep partial samples."""
    rows = with_score(groups, seed_col, id_col)
    rank = F.row_number().over(Window.partitionBy(group_col).orderBy("score", id_col))
    return rows.withColumn("place", rank).where(F.col("place") <= most).where(F.col("place") <= F.col(k_col)).drop("score")
