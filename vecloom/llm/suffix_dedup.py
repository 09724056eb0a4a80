"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts elsewhere.

A suffix array over all bytes would ship each byte hundreds of times. This one
is sparse: in every string of `length` bytes the smallest hash of its GRAM-byte
substrings picks one suffix (its anchor), equal strings pick equal anchors at
equal offsets, so all copies of a string meet at suffixes that begin alike.

1. Anchored suffixes become rows (leading 8 bytes, hash of the first GRAM bytes,
   hash of the stretch of strings that share the anchor, place). Splitters drawn
   from a sample of documents deal them to ranges by leading bytes, then by that
   hash; a suffix that starts a third of all rows repeats among the splitters and is
   spread over all of its ranges. Buckets are sorted; neighbours with the same
   stretch mark it as repeated.
2. Suffixes that begin alike but lie in differing stretches (edges of shared
   passages, edited copies) are few. Their bytes are fetched, range-partitioned
   by leading bytes again, and each bucket sorts all strings of its stretches by
   multikey quicksort: by the 8 leading bytes, then within ties by the next 64,
   then by the last 128 (both as 64-bit fingerprints).
3. What a bucket can't decide alone, because its first or last suffix continues
   in the next bucket, is compared across boundaries by key.
4. Marked stretches are merged by document and cut out of the bytes.

Null, empty, repeated: a null text is empty; texts shorter than `length` are
untouched; a repeated row is a repeat of all its bytes; an empty table gives an
empty result. Strings are judged on the input. Further columns are carried along; those named
like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .runtime import bounded_batches, compact, scan_tasks, stored

LENGTH = 200
#: Anchors are picked among substrings of this share of the length.
GRAM = 80
#: Rows and bytes that one bucket is planned to hold.
BUCKET_ROWS, BUCKET_SPANS = 200_000, 8_000
_PLACE = 0xFFFFF

ANCHORS = "bucket int, lead long, g long, f long, d long, t long, start int, n int, anchor int"
#: Sampled suffixes for each bucket.
SAMPLES = 64
MARKS = "kind int, k long, f long, d long, t long, start int, n int, anchor int"
SPANS = "kind int, k long, d long, t long, start int, n int, anchor int, bytes binary"
WINDOWS = "kind int, core long, d long, t long, start int, stop int, items array<struct<kind int, a long, b long, start int, stop int>>"
#: Strings at an edge travel together if their distances from the anchor differ by less than this.
STRIDE = 8


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, lead, g, f, start, count, distance from start to anchor) of the runs of strings that share an anchor; a block of at most 2**20 bytes.

    lead: the 8 bytes at the anchor, as an integer of the same order; g: hash of the first `gram` ones; f: hash of the run's stretch.
    """
    sums = V.prefix_sums(data)
    h = V.window_hash(sums, gram)
    w = length - gram + 1
    n = len(h) - w + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z, z
    low = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[w - span : w - span + n])
    at = (low & np.uint64(_PLACE)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    inside = np.arange(n) + length <= off[doc + 1]
    p = np.flatnonzero(inside)
    if not len(p):
        return p, p, p, p, p, p, p
    at, doc = at[p], doc[p]
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    first, last, at, doc = p[cut], p[np.r_[cut[1:] - 1, len(p) - 1]], at[cut], doc[cut]
    lead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)
    return doc, lead.view(np.int64), h[at].view(np.int64), V.span_hash(sums, first, last + length).view(np.int64), first - off[doc], last - first + 1, at - first


def _pieces(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Blocks of at most 2**20 bytes; a longer document comes in pieces that overlap by length - 1."""
    for i, _, part, o in V.blocks(data, off, _PLACE):
        if len(part) <= _PLACE:
            yield i, part, o, 0
        else:
            step = _PLACE - length
            for s in range(0, len(part) - length + 1, step):
                e = min(len(part), s + step + length - 1)
                yield i, part[s:e], np.array([0, e - s]), s


def _ranges(lead: np.ndarray, g: np.ndarray, place: np.ndarray, split: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Range of each (lead, g) among sorted splitters; equal splitters share theirs by place."""
    leads, gs = split
    out, high = np.searchsorted(leads, lead, side="left"), np.searchsorted(leads, lead, side="right")
    tied = np.flatnonzero(out < high)
    lows = out[tied]
    for low in np.unique(lows).tolist():
        rows = tied[lows == low]
        own = gs[low : high[rows[0]]]
        first, last = np.searchsorted(own, g[rows], side="left"), np.searchsorted(own, g[rows], side="right")
        out[rows] = low + np.where(last > first, first + 1 + place[rows] % np.maximum(last - first, 1), first)
    return out.astype(np.int32)


def _anchor_rows(length: int, gram: int, shared=None):
    """Rows of anchored suffixes, by ranges if there are splitters."""
    names = ["bucket", "lead", "g", "f", "d", "t", "start", "n", "anchor"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = shared.value if shared is not None else None
        for batch in batches:
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, off = V.arrow_text(batch.column(2))
            for i, part, o, s in _pieces(data, off, length):
                doc, lead, g, f, start, n, anchor = anchors(part, o, length, gram)
                if len(doc):
                    start = start + s
                    bucket = np.zeros(len(doc), np.int32) if split is None else _ranges(lead, g, (t[i + doc] >> 8) + start, split)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(lead), pa.array(g), pa.array(f), pa.array(d[i + doc]), pa.array(t[i + doc]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.astype(np.int32))], names)

    return rows


def _splitters(keyed: DataFrame, rows: int, buckets: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(lead, g) between the buckets, from a sample of documents; about SAMPLES suffixes a bucket reach the driver."""
    share = min(1.0, SAMPLES * buckets / max(rows, 1))
    sample = keyed if share == 1 else keyed.where(F.pmod(F.xxhash64("t", "d"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sample.mapInArrow(_anchor_rows(length, gram), ANCHORS).select("lead", "g").toArrow()
    lead, g = found["lead"].to_numpy(), found["g"].to_numpy()
    order = np.lexsort((g, lead))
    at = order[(np.arange(1, buckets) * len(order)) // buckets] if len(order) else order
    return lead[at], g[at]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Group number of each row of sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _mark_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: repeated stretch. 1: single stretch whose suffix begins like others. 2: one of a repeated stretch
    that such a suffix may match. 3, 4: single or repeated (one row) stretch at an edge of the bucket."""
    got = list(batches)
    if not got or not sum(len(b) for b in got):
        return
    table = pa.Table.from_batches(got)
    bucket, lead, g, f, d, t, start, n, anchor = (table[c].to_numpy() for c in ("bucket", "lead", "g", "f", "d", "t", "start", "n", "anchor"))
    order = np.lexsort((start, d, f, g, lead, bucket))
    bucket, lead, g, f, d, t, start, n, anchor = (c[order] for c in (bucket, lead, g, f, d, t, start, n, anchor))
    gk, gf = _runs(bucket, lead, g), _runs(bucket, lead, g, f)
    size = np.bincount(gf)
    first = np.r_[True, gf[1:] != gf[:-1]]
    single = size[gf] == 1
    variants = np.bincount(gk[first])
    open_k = (variants >= 2) & (np.bincount(gk, weights=single) > 0)
    ends = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # several ranges may share a task
    edge = np.isin(gk, np.r_[gk[ends], gk[np.r_[ends[1:] - 1, len(gk) - 1]]])
    # from here on: three leading bytes and 40 bits of the hash
    k = ((lead.view(np.uint64) ^ np.uint64(1 << 63)) & ~np.uint64((1 << 40) - 1) | (g.view(np.uint64) >> np.uint64(24))).view(np.int64)
    for kind, rows in ((0, ~single), (1, single & open_k[gk] & ~edge), (2, ~single & first & open_k[gk] & ~edge), (3, single & edge), (4, ~single & first & edge)):
        at = np.flatnonzero(rows)
        for i in range(0, len(at), 100_000):
            j = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), kind, np.int32)), *(pa.array(c[j]) for c in (k, f, d, t, start, n, anchor))], ["kind", "k", "f", "d", "t", "start", "n", "anchor"])


def _cut_spans(length: int):
    names = ["kind", "k", "d", "t", "start", "n", "anchor", "bytes"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, off = V.unpack(batch.column(2), batch.column(3).to_numpy())
            wanted = batch.column(4)
            doc = np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
            kind, k, start, n, anchor = (wanted.flatten().field(c).to_numpy() for c in range(5))
            begin = off[doc] + start
            raw = data.tobytes()
            cut = [raw[b : b + m] for b, m in zip(begin.tolist(), (n + length - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(k), pa.array(d[doc]), pa.array(t[doc]), pa.array(start), pa.array(n), pa.array(anchor), pa.array(cut, pa.binary())], names)

    return rows


def multikey_classes(keys: list, n: int) -> np.ndarray:
    """Multikey quicksort over n rows: partition by the first key, then only ties by the next ones.

    keys: functions from rows to the key at that depth. Returns a class for each row, -1 where it is alone.
    """
    rows, group = np.arange(n), np.zeros(n, np.int64)
    for key in keys:
        if not len(rows):
            break
        value = key(rows)
        order = np.lexsort((value, group))
        rows, group, value = rows[order], group[order], value[order]
        group = _runs(group, value)
        tied = np.bincount(group)[group] > 1
        rows, group = rows[tied], group[tied]
    out = np.full(n, -1, np.int64)
    out[rows] = group
    return out


def _compare_bucket(length: int):
    names = ["kind", "core", "d", "t", "start", "stop", "items"]
    item = pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: stretch of repeated strings. 1: strings of a suffix at an edge of the bucket, by the bytes that they
        have in common; items of kind 3 are single here, of 4 repeated (one each), of 5 single and need no mark."""
        got = list(batches)
        if not got or not sum(len(b) for b in got):
            return
        table = pa.Table.from_batches(got).combine_chunks()
        kind, k, d, t, start, n, anchor = (table[c].to_numpy() for c in ("kind", "k", "d", "t", "start", "n", "anchor"))
        column = table["bytes"].chunk(0) if table["bytes"].num_chunks else table["bytes"].combine_chunks()
        data, off = V.arrow_text(column)
        sums = V.prefix_sums(data)
        span = np.repeat(np.arange(len(k)), n)
        inner = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
        at = off[span] + inner
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)
        lead = lambda r: np.ascontiguousarray(eight[at[r]]).view(">u8")[:, 0].astype(np.uint64)
        middle = lambda r: V.span_hash(sums, at[r] + 8, at[r] + 72)
        rest = lambda r: V.span_hash(sums, at[r] + 72, at[r] + length)
        cls = multikey_classes([lead, middle, rest], len(at))
        mine = kind[span] == 1
        hit = np.flatnonzero((cls >= 0) & mine)
        if len(hit):
            cut = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (span[hit[1:]] != span[hit[:-1]])])
            last = hit[np.r_[cut[1:] - 1, len(hit) - 1]]
            hit = hit[cut]
            s = span[hit]
            z = np.zeros(len(s), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int32)), pa.array(z), pa.array(d[s]), pa.array(t[s]), pa.array((start[s] + inner[hit]).astype(np.int32)), pa.array((start[s] + inner[last] + length).astype(np.int32)), pa.nulls(len(s), pa.list_(item))], names)
        edge = (k == k.min()) | (k == k.max())
        one = np.zeros(len(at), bool)
        one[np.unique(cls, return_index=True)[1]] = True
        r = np.flatnonzero(((cls < 0) | one) & edge[span])
        step = (anchor[span[r]] - inner[r]) // STRIDE
        order = np.lexsort((step, span[r]))
        r, step = r[order], step[order]
        cut = np.flatnonzero(np.r_[True, (span[r][1:] != span[r][:-1]) | (step[1:] != step[:-1])]) if len(r) else r
        for i in range(0, len(cut), 20_000):
            c = cut[i : i + 20_000]
            stop = int(cut[i + 20_000]) if i + 20_000 < len(cut) else len(r)
            j, s = r[c[0] : stop], span[r[c]]
            begin = off[s] + anchor[s] - step[c] * STRIDE
            core = V.span_hash(sums, begin, begin + length - STRIDE + 1).view(np.int64)
            code = np.where(cls[j] >= 0, 4, np.where(mine[j], 3, 5)).astype(np.int32)
            first = (start[span[j]] + inner[j]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(code), pa.array(V.span_hash(sums, at[j], at[j] + 72).view(np.int64)), pa.array(rest(j).view(np.int64)), pa.array(first), pa.array(first + np.int32(length))], fields=list(item))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[c - c[0], len(j)].astype(np.int32)), items)
            z = np.zeros(len(c), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(z + np.int32(1)), pa.array(core), pa.array(d[s]), pa.array(t[s]), pa.array(z), pa.array(z), lists], names)

    return rows


def _spread(n: int, least: int, each: int) -> int:
    return max(least, -(-n // each))


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(d, t, spans): for each document key with repeats its marked (start, stop) stretches, not merged."""
    if not 16 <= gram <= length - 72 or length < 160:
        raise ValueError("gram must lie between 16 and length - 72")
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text")).where(F.octet_length(text_col) >= length)
    size = keyed.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    per_anchor = (length - gram + 2) // 2
    buckets = _spread(size // per_anchor, parts, BUCKET_ROWS)
    shared = spark.sparkContext.broadcast(_splitters(keyed, size // per_anchor, buckets, length, gram))  # 16 bytes a bucket
    rows = keyed.mapInArrow(_anchor_rows(length, gram, shared), ANCHORS)
    marks = rows.repartition(buckets, "bucket").mapInArrow(_mark_bucket, MARKS)
    marks = stored(marks, "suffix-marks", tasks=_spread(size // per_anchor, 1, BUCKET_ROWS))

    edges = marks.where("kind >= 3").groupBy("k", "f").agg(
        F.sum(F.when(F.col("kind") == 3, 1).otherwise(2)).alias("c"), F.min(F.struct("d", "t", "start", "n", "anchor")).alias("one"),
        F.collect_list(F.when(F.col("kind") == 3, F.struct("d", "t", "start", "n", "anchor"))).alias("singles"),  # at most one a bucket
    )
    open_k = edges.groupBy("k").agg(F.count(F.lit(1)).alias("variants"), F.min("c").alias("least")).where("variants >= 2 AND least = 1").select("k")
    more = edges.where("c >= 2").select(F.explode("singles").alias("s")).select("s.*")
    unsure = edges.join(open_k, "k").select(F.when(F.col("c") == 1, 1).otherwise(2).alias("kind"), "k", "one.*")
    unsure = marks.where("kind IN (1, 2)").select("kind", "k", "d", "t", "start", "n", "anchor").unionByName(unsure)
    wanted = unsure.groupBy("d", "t").agg(F.collect_list(F.struct("kind", "k", "start", "n", "anchor")).alias("wanted"))
    cut = V.packed(keyed).join(wanted.hint("merge"), ["d", "t"]).select("d", "t", "z", "size", "wanted").mapInArrow(_cut_spans(length), SPANS)
    n = marks.where("kind IN (1, 2)").count()
    found = cut.repartitionByRange(_spread(n, parts, BUCKET_SPANS), "k", "d", "start").mapInArrow(_compare_bucket(length), WINDOWS)
    found = stored(found, "suffix-windows", tasks=_spread(n, 1, BUCKET_SPANS))
    cores = found.where("kind = 1").withColumn("salt", F.pmod(F.xxhash64("d", "t"), F.lit(16)).cast("int"))  # a frequent core is spread
    often = cores.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("core", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    across = cores.join(often, ["core", "salt"]).select("d", "t", F.explode("items").alias("i")).select("d", "t", "i.*").groupBy("a", "b").agg(
        F.sum(F.when(F.col("kind") == 4, 2).otherwise(1)).alias("c"), F.collect_list(F.when(F.col("kind") == 3, F.struct("d", "t", "start", "stop"))).alias("singles"),  # at most one a bucket
    ).where("c >= 2").select(F.explode("singles").alias("s")).select("s.*")

    stop = (F.col("start") + F.col("n") - 1 + length).alias("stop")
    every = marks.where("kind = 0").select("d", "t", "start", stop).unionByName(more.select("d", "t", "start", stop))
    every = every.unionByName(found.where("kind = 0").select("d", "t", "start", "stop")).unionByName(across)
    return every.groupBy("d", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def document_key(id_col: str, text_col: str) -> list:
    """Two columns that tell documents apart; only rows equal in id and text share them."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text_col).alias("t")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """docs with kept (what remains), n_bytes, n_removed, n_spans and kept_sha256.

    kept is binary, as a cut may split a character; as_text: a string without such halves.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "_d", "_t", "_spans")
    spans = repeated_spans(docs, id_col, text_col, length, gram)
    names = docs.columns
    d, t = document_key(id_col, text_col)
    joined = docs.select("*", d.alias("_d"), t.alias("_t")).join(spans.select(F.col("d").alias("_d"), F.col("t").alias("_t"), "spans"), ["_d", "_t"], "left").select(*names, F.col("spans").alias("_spans"))
    schema = T.StructType(list(docs.schema.fields)).add("kept", "string" if as_text else "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = V.arrow_text(batch.column(batch.schema.get_field_index(text_col)))
            raw, column = data.tobytes(), batch.column(batch.schema.get_field_index("_spans"))
            at, flat = column.offsets.to_numpy(), column.values
            start, stop = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            kept, gone, runs = [], [], []
            for i in range(len(batch)):
                text, place, parts, lost, count = raw[off[i] : off[i + 1]], 0, [], 0, 0
                s, e = (start[at[i] : at[i + 1]], stop[at[i] : at[i + 1]]) if valid[i] else (start[:0], stop[:0])
                if len(s):
                    order = np.argsort(s, kind="stable")
                    s, top = s[order], np.maximum.accumulate(e[order])
                    new = np.flatnonzero(np.r_[True, s[1:] > top[:-1]])
                    for a, b in zip(s[new].tolist(), top[np.r_[new[1:] - 1, len(s) - 1]].tolist(), strict=True):
                        parts.append(text[place:a])
                        place, lost, count = b, lost + b - a, count + 1
                kept.append(b"".join([*parts, text[place:]]) if parts else text)
                gone.append(lost)
                runs.append(count)
            shas = [hashlib.sha256(x).hexdigest() for x in kept] if as_text else [None] * len(kept)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(names))), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(np.diff(off)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string())], schema.fieldNames())

    out = joined.mapInArrow(cut, schema)
    return compact(out if as_text else out.withColumn("kept_sha256", F.sha2("kept", 256)), scan_tasks(docs))
