"""Shared-folder tables: how these operators cut lineage and keep intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_tables: list[str] = []
_local: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one only where that is unset on a local master, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.TemporaryDirectory(prefix="vecloom-"))
    return f"file://{_local[0].name}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, known to release()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Results are lazy, so tables that nobody releases live as long as the application."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


#: Rows that one file of an intermediate table is planned to hold, where the number of rows is known.
FILE_ROWS = 100_000


def stored(df: DataFrame, name: str, rows: int | None = None, tasks: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: short lineage that survives lost executors.

    rows: a bound of its rows, if known; then it is written by as many tasks as these rows need.
    tasks: how many its input needs; then it is written by so many, or by two for each core if these are more.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    elif tasks is not None:
        df = compact(df, tasks)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, tasks: int) -> DataFrame:
    """df in at most `tasks` partitions, but at least two for each core: files of a fair size, however many partitions a shuffle had."""
    return df.coalesce(max(tasks, 2 * df.sparkSession.sparkContext.defaultParallelism))


def scan_tasks(df: DataFrame, each: int = 32 << 20) -> int:
    """Files of `each` bytes that df would fill, by the optimiser's estimate of its size; nothing is run."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(-(-size // each), 1 << 20)


#: Keys that join_spread may broadcast.
FREQUENT = 10_000


def join_spread(df: DataFrame, table: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df with the further columns of table, for the rows that have their keys there. Keys are unique in table and not null.

    rows: a bound of df's rows. At most FREQUENT keys have a FREQUENT-th of that or more; their rows of table are
    broadcast, so no task takes all rows of a frequent key. The other keys are shuffled.
    """
    often = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * FREQUENT >= rows).drop("_n")
    few = table.join(often, keys, "left_semi").withColumn("_often", F.lit(True))
    marked = df.join(F.broadcast(few), keys, "left")
    rest = marked.where("_often IS NULL").select(*df.columns).join(table, keys)
    return marked.where("_often").drop("_often").unionByName(rest)


def written() -> int:
    """How many intermediate tables there have been, as a mark for release()."""
    return len(_tables)


def release(spark: SparkSession, since: int, keep: str) -> None:
    """Delete the intermediate tables written after the mark `since`, once nothing reads them; names that begin with `keep` stay."""
    jvm = spark.sparkContext._jvm
    for path in [p for p in _tables[since:] if not p.rpartition("/")[2].startswith(keep)]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _tables.remove(path)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound Arrow batches by bytes: whole texts vary in length, and batches are held on both sides of the socket."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def crc_mod(doc_id: str, n: int):
    """crc32(doc_id as text) mod n, the hold-out rule of the queries; null stays null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
