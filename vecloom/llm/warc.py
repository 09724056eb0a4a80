"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: records of equal payloads of at least MIN_BYTES are told apart by their
smallest id (response) and the others (revisit, without payload); each partition
becomes gzipped archive files in the shared folder, each read back by one task.
Pages of a like size share files, so that a file holds at most MAX_BYTES, or one
page, however large some pages are. Reading: a task looks for the record magic anywhere in a file, parses
what follows as a header and emits (file, offset, successor's offset) for every
candidate; pointer jumping from offset 0 keeps the records that the chain
reaches, so magic inside a payload is rejected however real its header looks.
Bytes that the chain doesn't reach, as after a broken boundary or in a file cut
short, are told by a row of type `unread` with their place and number.

Null, empty, repeated: a null payload is empty, a null url is left out; rows with
the same id and payload are both `response` if that id is the smallest; a null id
is a revisit if any id has the payload, else a response; an empty table gives an
empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bounded_batches, delete_at_end, fresh_path

MIN_BYTES = 100
#: Bytes of an archive, unless it is a single page; classes of page sizes that share archives, the largest first.
MAX_BYTES = 128 << 20
CLASSES = (8 << 20, 512 << 10, 32 << 10)
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
RECORDS = "path string, at long, next long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Archive every row under `path`."""
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("n", F.octet_length("payload").cast("long"))
    first = p.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"))  # summed up before the shuffle
    p = p.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")), F.lit("")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    # the writer ends each value with a line feed, the last byte of a record
    p = p.select("n", F.concat(head, block, F.lit("\r\n\r")).alias("value"))
    bounds = [(None, CLASSES[0]), *zip(CLASSES, (*CLASSES[1:], -1), strict=True)]  # n in (low, high]
    within = [(F.col("n") > low) & (F.lit(True) if high is None else F.col("n") <= high) for high, low in bounds]
    sizes = pages.select(F.coalesce(F.octet_length(payload_col), F.lit(0)).alias("n")).agg(*[F.count(F.when(w, 1)) for w in within]).first()
    for (high, _), mine, rows in zip(bounds, within, sizes, strict=True):
        if rows or high == CLASSES[-1]:
            records = 1 if high is None else MAX_BYTES // (high + 1024)
            p.where(mine).select("value").write.mode("append").option("maxRecordsPerFile", records).option("compression", "gzip").text(path)


def unzip(raw: bytes) -> bytes:
    """All gzip members of a file, or the file itself if it isn't zipped. What can't be unzipped stays as it is, but for zeros at the end."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(raw))
        except zlib.error:
            break
        raw = d.unused_data
    return b"".join([*out, raw.rstrip(b"\0")])


def _number(urn: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", urn or b"")
    return int(m[1]) if m else None


def candidates(raw: bytes, payload: bool = False) -> Iterator[tuple]:
    """(offset, successor, id, type, payload bytes, digest, refers to, payload) wherever a record may begin."""
    for m in MAGIC.finditer(raw):
        at = m.start()
        end = raw.find(b"\r\n\r\n", m.end())
        if end < 0:
            continue
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in raw[m.end() : end].split(b"\r\n")))
        size = fields.get(b"content-length", b"")
        if not size.isdigit():
            continue
        begin = end + 4
        stop = begin + int(size)
        if raw[stop : stop + 4] != b"\r\n\r\n":
            continue
        kind = fields.get(b"warc-type", b"").decode("latin-1")
        body = raw.find(b"\r\n\r\n", begin, stop)
        content = raw[body + 4 : stop] if body >= 0 else b""
        n, digest = len(content), hashlib.sha256(content).hexdigest()
        if kind == "revisit":
            full = re.search(rb"(?im)^content-length:\s*(\d+)", raw[begin : max(body, begin) + 2])
            n = int(full[1]) if full else 0
            digest = fields.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("latin-1")
        yield at, stop + 4, _number(fields.get(b"warc-record-id")), kind, n, digest, _number(fields.get(b"warc-refers-to")), content if payload else None


def _scan(payload: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = unzip(content.as_py())
                rows = [*candidates(raw, payload), (len(raw), None, None, "end", 0, "", None, None)]
                if raw:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(rows)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], _NAMES)

    return scan


def reachable(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which offsets the chain from offset 0 reaches; pointer jumping, so few rounds for any number of records."""
    if not len(at):
        return np.zeros(0, bool)
    order = np.argsort(at)
    spot = np.minimum(np.searchsorted(at[order], following), len(at) - 1)
    end = len(at)
    jump = np.r_[np.where(at[order][spot] == following, order[spot], end), end]
    reach = np.r_[at == 0, False]
    while True:
        more = reach.copy()
        more[jump[np.flatnonzero(reach)]] = True
        jump = jump[jump]
        if (more == reach).all():
            return more[:end]
        reach = more


def _keep_chain(table):
    """The records of one file that the chain reaches, and a row for what it doesn't."""
    table = table.combine_chunks()
    is_end = table["record_type"].to_numpy() == "end"
    size = int(table["at"].to_numpy()[is_end][0])
    rows = table.filter(pa.array(~is_end))
    rows = rows.filter(pa.array(reachable(rows["at"].to_numpy(), rows["next"].to_numpy())))
    done = int(rows["next"].to_numpy().max()) if len(rows) else 0
    if done == size:
        return rows
    rest = {"path": table["path"][0].as_py(), "at": done, "next": size, "page_id": None, "record_type": "unread", "payload_bytes": size - done, "payload_digest": None, "refers_to": None, "payload": None}
    return pa.concat_tables([rows, pa.Table.from_pylist([rest], schema=table.schema)])


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of all archives under `path`, by the chain of their boundaries, and unread rests of files; payload: with its bytes."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = files.mapInArrow(_scan(payload), RECORDS)
    return found.groupBy("path").applyInArrow(_keep_chain, RECORDS)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write the pages as archives in the shared folder and read these back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, **columns)
    delete_at_end(spark, path)
    whole = F.when(F.col("record_type") == "unread", F.raise_error(F.concat(F.lit("unread bytes in "), "path"))).otherwise(F.col("record_type"))
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", whole.alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
