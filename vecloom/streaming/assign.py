"""Our own extension: vectors that arrive in a stream join the nearest leaders of a finished partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.knn import assign


def assign_stream(points: DataFrame, leaders: DataFrame, fanout: int) -> DataFrame:
    """The stateless assignment over a streaming (id, vec) table."""
    return assign(points, leaders, fanout)


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch once: a batch that is repeated after a failure overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
