"""Binary matrices and neighbour graphs: a Python data source for ranged reads, ordered single-file exports.

Layouts (little endian): matrix: i32 rows, i32 columns, then rows x columns values; sized: u32 count, then values;
raw: values only; sketch: u64 rows, u64 columns, then f32 values; graph: u64 file size, u32 largest degree, u32 start,
u64 frozen nodes, then for each node u32 degree and u32 neighbours.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DTYPES = {"f32": ("<f4", "float"), "i32": ("<i4", "int"), "u32": ("<u4", "long"), "u64": ("<u8", "long"), "f64": ("<f8", "double"), "u8": ("u1", "int"), "i8": ("i1", "int")}
HEADERS = {"matrix": "<ii", "sketch": "<QQ", "sized": "<I", "raw": ""}
#: Bytes that one task reads.
SPLIT_BYTES = 32 << 20
GRAPH_HEAD = "<QIIQ"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def read_at(path: str, offset: int, size: int) -> bytes:
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        f.seek(offset)
        return f.read(size)


def file_size(path: str) -> int:
    fs, p = opened(path)
    return fs.get_file_info(p).size or 0


def metadata(path: str, layout: str = "matrix", dtype: str = "f32", offset: int = 0, columns: int = 0) -> tuple[int, int, int]:
    """(rows, columns, where values begin); a file that is too short for its header's numbers is refused."""
    head = HEADERS[layout]
    begin, width = offset + struct.calcsize(head), np.dtype(DTYPES[dtype][0]).itemsize
    raw = read_at(path, offset, struct.calcsize(head))
    if len(raw) < struct.calcsize(head):
        raise ValueError(f"{path}: no header")
    numbers = struct.unpack(head, raw) if head else ()
    if layout in ("matrix", "sketch"):
        rows, columns = numbers
    else:
        columns = columns or 1
        rows = numbers[0] // columns if numbers else (file_size(path) - begin) // (columns * width)
    if rows < 0 or columns < 0 or file_size(path) < begin + rows * columns * width:
        raise ValueError(f"{path}: {rows} x {columns} values don't fit the file")
    return rows, columns, begin


class Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.layout, self.dtype = options["path"], options.get("layout", "matrix"), options.get("dtype", "f32")
        self.rows, self.columns, self.begin = metadata(self.path, self.layout, self.dtype, int(options.get("offset", 0)), int(options.get("columns", 0)))
        self.rows = min(self.rows, int(options.get("limit", self.rows)))
        self.first_id = int(options.get("firstid", 0))

    def partitions(self) -> list[InputPartition]:
        step = max(1, SPLIT_BYTES // max(1, self.columns * np.dtype(DTYPES[self.dtype][0]).itemsize))
        return [Range(i, min(self.rows, i + step)) for i in range(0, self.rows, step)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(DTYPES[self.dtype][0])
        width, n = kind.itemsize * self.columns, partition.last - partition.first
        values = np.frombuffer(read_at(self.path, self.begin + partition.first * width, n * width), kind)
        if values.dtype.kind == "u" and kind.itemsize >= 4 or DTYPES[self.dtype][1] == "int":
            values = values.astype(np.int64 if DTYPES[self.dtype][1] == "long" else np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(self.columns)), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.last, dtype=np.int64) + self.first_id), lists], ["id", "vec"])


class MatrixSource(DataSource):
    """Options: path, layout (matrix, sized, raw, sketch), dtype, offset (bytes before the header), columns (sized and raw), limit (rows), firstId."""

    @classmethod
    def name(cls) -> str:
        return "vecmatrix"

    def schema(self) -> str:
        return f"id long, vec array<{DTYPES[self.options.get('dtype', 'f32')][1]}>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(dict(self.options))


def read_matrix(spark: SparkSession, path: str, **options) -> DataFrame:
    """(id, vec): id is the row's place in the file."""
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("vecmatrix").option("path", path)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def append(first: DataFrame, spark: SparkSession, path: str, count: int | None = None, **options) -> DataFrame:
    """first with the rows of a file, numbered on from first's last id."""
    last = first.agg(F.max("id")).first()[0]
    start = 0 if last is None else last + 1
    more = read_matrix(spark, path, firstId=start, **options, **({} if count is None else {"limit": count}))
    return first.unionByName(more)


def write_matrix(df: DataFrame, path: str, layout: str = "matrix", dtype: str = "f32") -> int:
    """Export (id, vec) in order of id as one file; rows are streamed through the driver, one partition at a time."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.min(F.size("vec")).alias("e")).first()
    rows, columns = stats["n"], stats["d"] or 0
    if rows and stats["e"] != columns:
        raise ValueError("vectors differ in length")
    head = {"matrix": (rows, columns), "sketch": (rows, columns), "sized": (rows * columns,), "raw": ()}[layout]
    fs, p = opened(path)
    with fs.open_output_stream(p) as out:
        out.write(struct.pack(HEADERS[layout], *head))
        for row in df.select("vec").orderBy(df["id"]).toLocalIterator():
            out.write(np.asarray(row[0], dtype=DTYPES[dtype][0]).tobytes())
    return rows


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): a sized list of u32, such as ids to delete; use it as the right side of a left_anti join."""
    return read_matrix(spark, path, layout="sized", dtype="u32").select(F.col("vec")[0].alias("id"))


def read_truth(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(query_id, rank, id): the first k ids of each row of a ground truth; a narrower file is refused."""
    if metadata(path, dtype="u32")[1] < k:
        raise ValueError(f"{path}: fewer than {k} ids a query")
    rows = read_matrix(spark, path, dtype="u32").select(F.col("id").alias("query_id"), F.posexplode(F.slice("vec", 1, k)).alias("rank", "id"))
    return rows.withColumn("rank", F.col("rank") + 1)


def write_results(found: DataFrame, path: str, k: int, pad: bool = False) -> int:
    """Export (query_id, rank, id) as a u32 matrix of k columns; short rows are refused unless `pad` fills them with 0."""
    lists = found.where(F.col("rank") <= k).groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("vec"))
    if pad:
        lists = lists.withColumn("vec", F.slice(F.concat("vec", F.array_repeat(F.lit(0).cast("long"), k)), 1, k))
    return write_matrix(lists, path, dtype="u32")


def result_path(base: str, width: int, several: bool) -> str:
    """With several beam widths, base.ext becomes base.L<width>.ext."""
    if not several:
        return base
    stem, dot, ext = base.rpartition(".")
    return f"{stem}.L{width}.{ext}" if dot and "/" not in ext else f"{base}.L{width}"


def write_graph(graph: DataFrame, path: str, start: int, frozen: int = 0) -> int:
    """Export (id, nbrs) with ids 0..n-1 in order as one graph file; the header's size is known from the degrees."""
    s = graph.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("nbrs")), F.lit(0)).alias("e"), F.coalesce(F.max(F.size("nbrs")), F.lit(0)).alias("d"), F.max("id").alias("top")).first()
    if s["n"] and (s["top"] != s["n"] - 1 or not 0 <= start < s["n"]):
        raise ValueError("ids must be 0..n-1 and the start one of them")
    fs, p = opened(path)
    with fs.open_output_stream(p) as out:
        out.write(struct.pack(GRAPH_HEAD, struct.calcsize(GRAPH_HEAD) + 4 * (s["n"] + s["e"]), s["d"], start, frozen))
        for row in graph.select("nbrs").orderBy("id").toLocalIterator():
            out.write(np.asarray([len(row[0]), *row[0]], dtype="<u4").tobytes())
    return s["n"]


def read_graph(spark: SparkSession, path: str, expected: int | None = None) -> tuple[DataFrame, int]:
    """((id, nbrs), start). Records are chained by their degrees, so one task walks the file; sizes are checked."""
    size, degree, start, _ = struct.unpack(GRAPH_HEAD, read_at(path, 0, struct.calcsize(GRAPH_HEAD)))
    if size != file_size(path) or size % 4:
        raise ValueError(f"{path}: the header says {size} bytes, the file has {file_size(path)}")

    def walk(batches):
        for _ in batches:
            words = np.frombuffer(read_at(path, struct.calcsize(GRAPH_HEAD), size - struct.calcsize(GRAPH_HEAD)), "<u4")
            at, node, ids, lists = 0, 0, [], []
            while at < len(words):
                n = int(words[at])
                if n > degree or at + 1 + n > len(words):
                    raise ValueError(f"{path}: record {node} overflows")
                ids.append(node)
                lists.append(words[at + 1 : at + 1 + n].astype(np.int64))
                at, node = at + 1 + n, node + 1
                if len(ids) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["id", "nbrs"])
                    ids, lists = [], []
            if expected is not None and node != expected:
                raise ValueError(f"{path}: {node} nodes instead of {expected}")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["id", "nbrs"])

    return spark.range(0, 1, 1, 1).mapInArrow(walk, "id long, nbrs array<bigint>"), start
