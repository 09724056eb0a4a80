"""Benchmark decontamination with a distributed positional inverted index.

`build_index` tokenises whole texts in blocks of documents and stores, for each
(block, term), the ascending positions of the term: a written table in the
shared folder, made by one scan of the corpus whatever the size of the benchmark.
Only terms that pass a sieve of the benchmark's words are kept (a bitmap of fixed
size; a term that passes by chance costs a row and changes nothing).

Windows of the items are a table too. The terms of a window are ordered from the
rarest on, by corpus frequencies summed into a table of fixed size (terms that
share a cell may change the order, not the result). A window goes to the blocks
that hold its rarest term, by a join with the postings; there each position of
that term is a candidate, and the next terms' lists, offset by their place in the
window, leave fewer and fewer of them. A block is bounded, so a term that makes up
a third of all tokens is spread over all blocks.

Neither items nor windows reach the driver. The work grows with the sum, over
windows, of the blocks that hold the rarest term.

Null, empty, repeated: null or empty texts have no words and are never hit;
items without words have no windows; repeated documents are separate rows with
the same result; repeated items count each; an item with a null id counts and
marks words but can't be listed. Further columns of the inputs are ignored. The
index holds only what the sieve of these items lets through: other items need
another index, or one built without a sieve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .runtime import bounded_batches, stored

#: Text in one block of the index.
BLOCK = 4 << 20
#: Bits of the sieve's bitmap and of the table of frequencies: 4 MB and 8 MB.
SIEVE_BITS, CELL_BITS = 25, 20
#: Candidate places that are checked at once.
CANDIDATES = 1 << 20

#: Words are runs of a-z, 0-9 and bytes above 0x7F (after lower-casing A-Z).
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[0x00:0x30] = SEPARATOR[0x3A:0x61] = SEPARATOR[0x7B:0x80] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit term ids and the document of each token."""
    ids, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, _, part, o in V.blocks(data, off):
        low = V.LOWER[part]
        start, end, doc = V.words(low, o, SEPARATOR)
        ids.append(V.span_hash(V.prefix_sums(low), start, end).view(np.int64))
        docs.append(doc + i)
    return np.concatenate(ids), np.concatenate(docs)


def _bit(term: np.ndarray, bits: int) -> np.ndarray:
    return (term.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def sieve(items: DataFrame, text_col: str = "text") -> np.ndarray:
    """Bitmap of the words of the items, 64 bits in a value."""
    bits = SIEVE_BITS

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = V.arrow_text(batch.column(0))
            for _, _, part, o in V.blocks(data, off):
                bit = np.unique(_bit(tokens(part, o)[0], bits))
                yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.int64(1) << (bit & 63))], ["at", "bits"])

    rows = items.select(text_col).mapInArrow(words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2 ** (SIEVE_BITS - 6)
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _windows(width: int, shared):
    """(item key, item id, text) -> distinct windows of each item: terms in their places and from the rarest on."""
    names = ["k", "w", "key", "m", "terms", "order"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            key = batch.column(0).to_numpy()
            data, off = V.arrow_text(batch.column(1))
            term, doc = tokens(data, off)
            count = np.bincount(doc, minlength=len(batch))
            first = np.cumsum(count) - count
            for m in np.unique(np.minimum(count[count > 0], width)).tolist():
                mine = np.flatnonzero((count >= m) if m == width else (count == m))
                starts = np.concatenate([np.arange(f, f + n - m + 1) for f, n in zip(first[mine], count[mine], strict=True)])
                sums = np.zeros(len(term) + 1, np.uint64)
                np.cumsum(V.mix(term.view(np.uint64)) * V._power(V._BASE, len(term), "p"), out=sums[1:])
                w = V.span_hash(sums, starts, starts + m).view(np.int64)
                _, keep = np.unique(np.column_stack([doc[starts], w]), axis=0, return_index=True)
                starts, w = starts[keep], w[keep]
                for i in range(0, len(starts), 10_000):
                    s = starts[i : i + 10_000]
                    terms = term[s[:, None] + np.arange(m)]
                    n = frequency[terms & (len(frequency) - 1)]
                    order = np.argsort(n, axis=1, kind="stable").astype(np.int8)
                    live = n.min(axis=1) > 0  # a term that the corpus lacks
                    s, terms, order, own = s[live], terms[live], order[live], w[i : i + 10_000][live]
                    rarest = np.take_along_axis(terms, order[:, :1].astype(np.int64), axis=1)[:, 0]
                    fixed = lambda x, size: pa.Array.from_buffers(pa.binary(size), len(s), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(key[doc[s]]), pa.array(own), pa.array(rarest), pa.array(np.full(len(s), m, np.int32)), fixed(terms.astype("<i8"), 8 * m), fixed(order, m)], names)

    return windows


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bitmap: np.ndarray | None = None) -> DataFrame:
    """(block, term, positions) and, with term null, a row for each document: id, first token, tokens.

    bitmap: only postings of terms that this sieve lets through are stored. None: all terms.
    """
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = T.StructType().add("block", "long").add("term", "long").add("positions", "binary").add("doc", kind).add("slot", "integer").add("first", "long").add("n_words", "long")
    names, limit = schema.fieldNames(), BLOCK
    bits = len(bitmap).bit_length() + 5 if bitmap is not None else 0

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep, block = shared.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, (data, off) = batch.column(0), V.arrow_text(batch.column(1))
            for i, j, part, o in V.blocks(data, off, limit):
                term, doc = tokens(part, o)
                n = j - i
                count = np.bincount(doc, minlength=n).astype(np.int64)
                first = np.cumsum(count) - count
                at = np.arange(len(term))
                if keep is not None:
                    bit = _bit(term, bits)
                    at = np.flatnonzero((keep[bit >> 6] >> (bit & 63)) & 1)
                order = at[np.argsort(term[at], kind="stable")]
                cut = np.flatnonzero(np.r_[True, term[order][1:] != term[order][:-1]]) if len(order) else np.zeros(0, np.int64)
                raw = order.astype("<i4")
                bounds = np.r_[cut, len(order)].astype(np.int64) * 4
                lists = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                k = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), ids[i:j], pa.array(np.arange(n, dtype=np.int32)), pa.array(first), pa.array(count)], names)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(term[order][cut]), lists, pa.nulls(k, ids.type), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
                block += 1

    return stored(docs.select(id_col, text_col).mapInArrow(post, schema), "postings")


class _Block:
    """Postings of one block, for places of candidates."""

    def __init__(self, posts: pa.Table, size: int):
        term, lists = posts["term"].to_numpy(), posts["positions"].combine_chunks()
        order = np.argsort(term)
        self.term, self.size = term[order], size
        own = [np.frombuffer(lists[i].as_buffer(), "<i4") for i in order.tolist()]
        self.at = np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64)
        n = np.array([len(x) for x in own], np.int64)
        self.first, self.n = np.cumsum(n) - n, n
        self.rank = np.repeat(np.arange(len(n)), n)

    def find(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.term):
            return np.zeros(len(term), np.int64), np.zeros(len(term), bool)
        spot = np.minimum(np.searchsorted(self.term, term), len(self.term) - 1)
        return spot, self.term[spot] == term

    def candidates(self, key: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position) for every posting of the windows' rarest terms, so many at once."""
        spot, found = self.find(key)
        win = np.flatnonzero(found)
        n = self.n[spot[win]]
        ends = np.cumsum(n)
        i = 0
        while i < len(win):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
            size = n[i:j]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield np.repeat(win[i:j], size), self.at[np.repeat(self.first[spot[win[i:j]]], size) + inner]
            i = j


def _phrases(block: _Block, key: np.ndarray, terms: np.ndarray, order: np.ndarray, m: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, end) of all exact occurrences: offset-adjusted intersection from the rarest term."""
    token = np.zeros(block.size, np.int64)  # the term at each position, as far as it is indexed
    token[block.at] = block.term[block.rank] if len(block.rank) else 0
    indexed = np.zeros(block.size, bool)
    indexed[block.at] = True
    found = [(np.zeros(0, np.int64),) * 2]
    for win, at in block.candidates(key, most):
        start = at - order[win, 0]
        ok = (start >= 0) & (start + m <= block.size)
        win, start = win[ok], start[ok]
        for r in range(1, m):
            k = order[win, r].astype(np.int64)
            hit = indexed[start + k] & (token[start + k] == terms[win, k])
            win, start = win[hit], start[hit]
        found.append((win, start))
    win, start = (np.concatenate(x) for x in zip(*found, strict=True))
    return win, start, start + m


def _near(block: _Block, key: np.ndarray, terms: np.ndarray, order: np.ndarray, m: int, most: int, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, position of its rarest term, next) where every other term lies within `slop` words of it."""
    line = block.rank * (block.size + 1) + block.at  # ascending
    found = [(np.zeros(0, np.int64),) * 2]
    for win, at in block.candidates(key, most):
        for r in range(1, m):
            rank, known = block.find(np.take_along_axis(terms[win], order[win, r : r + 1].astype(np.int64), axis=1)[:, 0])
            low = np.searchsorted(line, rank * (block.size + 1) + np.maximum(at - slop, 0))
            hit = known & (low < len(line))
            hit &= line[np.minimum(low, len(line) - 1)] <= rank * (block.size + 1) + np.minimum(at + slop, block.size - 1)
            win, at = win[hit], at[hit]
        found.append((win, at))
    win, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return win, at, at + 1


def _intersecting(schema: T.StructType, proximity: int | None):
    """The function for one block of the index and the windows whose rarest term it holds."""
    most = CANDIDATES

    def intersect(table, windows):
        is_doc = table["term"].is_null().to_numpy(zero_copy_only=False)
        rows, posts = table.filter(pa.array(is_doc)).sort_by("slot"), table.filter(pa.array(~is_doc))
        first, n_words = rows["first"].to_numpy(), rows["n_words"].to_numpy()
        block = _Block(posts, int(n_words.sum()))
        length = windows["m"].to_numpy()
        got = [(np.zeros(0, np.int64),) * 3]
        for m in np.unique(length).tolist():
            mine = windows.filter(pa.array(length == m))
            key, name = mine["key"].to_numpy(), mine["w"].to_numpy()
            terms = np.frombuffer(b"".join(mine["terms"].to_pylist()), "<i8").reshape(-1, m)
            order = np.frombuffer(b"".join(mine["order"].to_pylist()), np.int8).reshape(-1, m)
            win, start, end = _phrases(block, key, terms, order, m, most) if proximity is None else _near(block, key, terms, order, m, most, proximity)
            got.append((name[win], start, end))
        name, start, end = (np.concatenate(x) for x in zip(*got, strict=True))
        doc = np.searchsorted(first, start, side="right") - 1
        fits = end <= (first + n_words)[doc]
        name, start, end, doc = name[fits], start[fits], end[fits], doc[fits]
        spans: list[list[int]] = [[] for _ in range(len(rows))]
        for k in np.lexsort((end, start, doc)):
            own, s, e = spans[doc[k]], int(start[k] - first[doc[k]]), int(end[k] - first[doc[k]])
            if own and s <= own[-1]:
                own[-1] = max(own[-1], e)
            else:
                own += [s, e]
        d, w = V.distinct_pairs(doc, name)
        at = np.searchsorted(d, np.arange(len(rows) + 1)).astype(np.int32)
        return pa.table([rows["block"], rows["slot"], rows["doc"], rows["n_words"], pa.array(spans, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(at), pa.array(w))], schema.fieldNames())

    return intersect


def match(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", proximity: int | None = None) -> DataFrame:
    """One row for each document: doc, n_words, n_hit, n_items, items (ids as strings, sorted), spans (start, end in words).

    proximity: instead of exact phrases, windows whose terms all lie within so many words of their rarest one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = stored(items.select(F.monotonically_increasing_id().alias("k"), F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")), "decontam-items")
    index = build_index(docs, id_col, text_col, sieve(items, "text"))
    posts = index.where(F.col("term").isNotNull())
    rows = posts.groupBy(F.col("term").bitwiseAND((1 << CELL_BITS) - 1).alias("cell")).agg(F.sum(F.length("positions")).alias("n")).toArrow()  # at most 2 ** CELL_BITS
    frequency = np.zeros(1 << CELL_BITS, np.int64)
    frequency[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    shared = spark.sparkContext.broadcast(frequency)
    windows = stored(items.select("k", "text").mapInArrow(_windows(width, shared), "k long, w long, key long, m int, terms binary, order binary"), "decontam-windows")

    kind = docs.schema[id_col].dataType
    schema = T.StructType().add("block", "long").add("slot", "integer").add("doc", kind).add("n_words", "long").add("spans", T.ArrayType(T.IntegerType())).add("windows", T.ArrayType(T.LongType()))
    dealt = posts.select(F.col("block").alias("at"), F.col("term").alias("key")).join(windows.drop("k").dropDuplicates(["w"]), "key").select("at", "key", "w", "m", "terms", "order")
    found = stored(index.groupBy("block").cogroup(dealt.groupBy("at")).applyInArrow(_intersecting(schema, proximity), schema), "decontam-found")
    hits = found.where(F.size("windows") > 0).select("block", "slot", F.explode("windows").alias("w")).join(windows.select("w", "k"), "w").select("block", "slot", "k").distinct()
    named = hits.join(items.select("k", "item"), "k").groupBy("block", "slot").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    hit = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.element_at("spans", i + 2) - F.element_at("spans", i + 1)), F.lit(0), lambda a, x: a + x)
    n_hit = F.when(F.size("spans") > 0, hit).otherwise(F.lit(0)).cast("long")
    out = found.drop("windows").join(named, ["block", "slot"], "left")
    return out.select("doc", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT k, item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT k, item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM v),
lens AS (SELECT DISTINCT m FROM win),
dg AS (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM t, lens WHERE len(w) >= m),
hits AS (SELECT r, dg.m, i, k, item_id FROM dg JOIN win ON dg.m = win.m AND array_to_string(list_slice(w, i, i + dg.m - 1), ' ') = g),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, k, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""
