"""Near-duplicate documents: b-bit MinHash, multi-index Hamming join, exact confirmation.

1. Whole texts become sets of k-word shingles and signatures of CHUNKS x WIDTH
   b-bit minima. Equal sets form one class and are handled once.
2. A signature is split into chunks. Two signatures that differ in fewer than
   2 * CHUNKS = DISTANCE places have, by pigeonhole, a chunk with at most one error,
   so they share one of the keys (chunk, place left out, the other minima): all
   allowed errors are enumerated and every pair under the distance is found. At
   a similarity of 0.75 the distance is 16 of 64 on average; 32 is 4.6 standard
   deviations away. Keys are range-partitioned with the class as a tie-breaker,
   so a frequent key is spread.
3. Classes that share a key are compared by their signatures; of the pairs under
   the distance a spanning forest leaves the task, never all pairs. A class found
   near leaves the pool, so a tight group costs as many comparisons as it has
   members. A run of more than RUN_ROWS classes is compared in pairs of blocks.
4. Components of these links are the candidate groups. They are cut into blocks of
   bounded size; in each pair of blocks, sets of a like size whose signatures are
   under the distance are intersected in full, again as a spanning forest.
5. Connected components of the confirmed links.

Null, empty, repeated: no words, an empty set, linked with nothing; rows of the
same id are one document if their texts agree; a null id never represents a
group unless no other does; an empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectext as V
from .components import components
from .runtime import FILE_ROWS, bounded_batches, compact, join_spread, scan_tasks, stored

SHINGLE = 5
CHUNKS, WIDTH, B_BITS = 16, 4, 16
#: Pairs at a smaller distance of signatures are candidates.
DISTANCE = 2 * CHUNKS
#: Rows of a range bucket; classes of a frequent key that are compared at once; shingles in a block of a large candidate group.
BUCKET_ROWS, RUN_ROWS, BLOCK_SHINGLES = 400_000, 4_000, 1_500_000
_rng = np.random.Generator(np.random.PCG64(11))
_A = _rng.integers(0, 2**64, CHUNKS * WIDTH, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, CHUNKS * WIDTH, dtype=np.uint64)

NO_ID = 2**63 - 1
SETS = "d long, t long, n long, s1 long, s2 long, signature binary"


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document, shingle hash) of one block; A-Z lower-cased."""
    low = V.LOWER[data]
    start, end, doc = V.words(low, off)
    return V.distinct_pairs(*V.shingle_hashes(V.span_hash(V.prefix_sums(low), start, end), doc, len(off) - 1, k))


def signatures(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, two order-free 64-bit set hashes, and signatures (documents x minima, 16 bits each)."""
    count = np.bincount(doc, minlength=n_docs)
    sig = np.zeros((n_docs, CHUNKS * WIDTH), np.uint16)
    s1, s2 = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        first = (np.cumsum(count) - count)[some]
        s1[some] = np.add.reduceat(V.mix(value), first)
        s2[some] = np.add.reduceat(V.mix(value ^ np.uint64(0x5851F42D4C957F2D)), first)
        for i in range(CHUNKS * WIDTH):
            sig[some, i] = (np.minimum.reduceat(value * _A[i] + _B[i], first) >> np.uint64(24)).astype(np.uint16)
    return count, s1, s2, sig


def _set_rows(k: int):
    names = ["d", "t", "n", "s1", "s2", "signature"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = V.arrow_text(batch.column(2))
            for i, j, part, o in V.blocks(data, off):
                count, s1, s2, sig = signatures(*shingle_sets(part, o, k), j - i)
                raw = pa.Array.from_buffers(pa.binary(sig.shape[1] * 2), j - i, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(count.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), raw], names)

    return rows


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """classes x (CHUNKS * WIDTH): for each chunk and place left out, the other minima as one integer."""
    s = sig.astype(np.int64)
    out = []
    for c in range(CHUNKS):
        for p in range(WIDTH):
            key = np.full(len(s), c * WIDTH + p, np.int64)
            for q in range(WIDTH):
                if q != p:
                    key = (key << B_BITS) | s[:, c * WIDTH + q]
            out.append(key)
    return np.column_stack(out)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), -1)
            keys = chunk_keys(sig)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["key", "c"])


def _run_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c, n) of runs of n > 1 equal keys; n is null for the first and last run of the bucket, which may go on in the next."""
    got = list(batches)
    if not got or not sum(len(b) for b in got):
        return
    table = pa.Table.from_batches(got)
    key, c = table["key"].to_numpy(), table["c"].to_numpy()
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[new, len(key)])
    n = np.repeat(size, size)
    edge = np.repeat(np.isin(np.arange(len(size)), (0, len(size) - 1)), size)
    at = np.flatnonzero((n > 1) | edge)
    yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(c[at]), pa.array(n[at], mask=edge[at])], ["key", "c", "n"])


def forest(left: np.ndarray, right: np.ndarray, near) -> list[tuple[int, int]]:
    """A spanning forest of the graph between left and right (or within left, if they are equal), as pairs.

    near(i, pool): those of pool that i is linked to. What has been reached leaves the pool.
    """
    same = np.array_equal(left, right)
    pools = [left, left if same else right]
    found: list[tuple[int, int]] = []
    reached: set[int] = set()
    for seed in left.tolist():
        if seed in reached:
            continue
        stack = [(seed, 0)]
        pools[0] = pools[0][pools[0] != seed]
        while stack:
            x, side = stack.pop()
            other = 0 if same else 1 - side
            if not len(pools[other]):
                continue
            hits = near(x, pools[other])
            if len(hits):
                pools[other] = pools[other][~np.isin(pools[other], hits)]
                hits = hits.tolist()
                found += [(x, h) for h in hits]
                reached.update(hits)
                stack += [(h, other) for h in hits]
    return found


def _apart(signature: np.ndarray, i: int, pool: np.ndarray) -> np.ndarray:
    return (signature[pool] != signature[i]).sum(axis=1)


def _near_in_runs(table):
    """A spanning forest of the pairs under the distance in each run of a task."""
    table = table.combine_chunks()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    key, c, block = (table[x].to_numpy() for x in ("key", "c", "block"))
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(len(table), -1)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    size = np.diff(np.r_[cuts, len(order)])
    a, b = [], []
    two = cuts[(size == 2) & (i < 0)]
    x, y = order[two], order[two + 1]
    close = (signature[x] != signature[y]).sum(axis=1) < DISTANCE
    a.append(x[close])
    b.append(y[close])
    near = lambda k, pool: pool[_apart(signature, k, pool) < DISTANCE]
    for s, n in zip(cuts.tolist(), size.tolist(), strict=True):
        if n > 2 or i >= 0:
            rows = order[s : s + n]
            pairs = forest(rows, rows, near) if i < 0 else forest(rows[block[rows] == i], rows[block[rows] == j], near)
            a.append(np.array([p for p, _ in pairs], np.int64))
            b.append(np.array([q for _, q in pairs], np.int64))
    a, b = c[np.concatenate(a)], c[np.concatenate(b)]
    links = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})


def _block_pairs(task) -> Column:
    """What a row of block `block` of `blocks` takes part in: the pairs of its block with each block, by task."""
    return F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(task.alias("task"), F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))


def candidate_links(classes: DataFrame, parts: int) -> DataFrame:
    """(a, b): links that connect all classes whose signatures are under the distance. classes: c, signature."""
    rows = classes.count() * CHUNKS * WIDTH
    buckets = max(parts, -(-rows // BUCKET_ROWS))
    keys = classes.select("c", "signature").mapInArrow(_key_rows, "key long, c long")
    runs = stored(keys.repartitionByRange(buckets, "key", "c").mapInArrow(_run_members, "key long, c long, n long"), "near-runs")
    edges = runs.where("n IS NULL").select("key", "c")
    # a key that fills many buckets is dealt by class as well
    counts = edges.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    across = edges.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(16)).cast("int")).join(counts, ["key", "salt"]).select("key", "c", "n")
    runs = runs.where("n IS NOT NULL").unionByName(across).withColumn("blocks", F.ceil(F.col("n") / RUN_ROWS).cast("int")).withColumn("block", F.pmod(F.xxhash64("c", "key"), "blocks").cast("int"))
    one = F.array(F.struct(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    dealt = runs.join(classes.select("c", "signature"), "c").select("key", "c", "signature", "block", F.explode(F.when(F.col("blocks") == 1, one).otherwise(_block_pairs(F.col("key")))).alias("p")).select("key", "c", "signature", "block", "p.*")
    return dealt.groupBy("task", "i", "j").applyInArrow(_near_in_runs, "a long, b long")


def exact_links(value: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, signature: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of all pairs left x right with 100 * |intersection| >= percent * |union|.

    value: sorted set elements, those of set i in first[i]:first[i + 1]. signature: only pairs under the distance are intersected.
    """
    _, ids = np.unique(value, return_inverse=True)
    size = np.diff(first)
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int32)
    by_size = lambda x: (lambda y: y[np.argsort(size[y], kind="stable")])(x[size[x] > 0])

    def near(i: int, pool: np.ndarray) -> np.ndarray:
        n = int(size[i])
        # only sets of a similar size can be linked
        low, high = np.searchsorted(size[pool], -(-n * percent // 100)), np.searchsorted(size[pool], n * 100 // percent, side="right")
        pool = pool[low:high]
        if signature is not None and len(pool):
            pool = pool[_apart(signature, i, pool) < DISTANCE]
        if not len(pool):
            return pool
        own, sizes = ids[first[i] : first[i + 1]], size[pool]
        begin = np.cumsum(sizes) - sizes
        mark[own] = 1
        common = np.add.reduceat(mark[ids[np.repeat(first[pool] - begin, sizes) + np.arange(sizes.sum())]], begin)
        mark[own] = 0
        return pool[100 * common >= percent * (n + sizes - common)]

    return forest(by_size(left), by_size(right), near)


def _confirm(k: int, percent: int):
    def confirm(table):
        table = table.sort_by([("g", "ascending"), ("c", "ascending")])
        data, off = V.unpack(table["z"], table["size"].to_numpy())
        docs, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, _, part, o in V.blocks(data, off):
            d, v = shingle_sets(part, o, k)
            docs.append(d + i)
            values.append(v)
        value = np.concatenate(values)
        first = np.r_[0, np.cumsum(np.bincount(np.concatenate(docs), minlength=len(table)))]
        signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(len(table), -1)
        group, block, c = table["g"].to_numpy(), table["block"].to_numpy(), table["c"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        out = []
        cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows, local = value[first[x] : first[y]], first[x : y + 1] - first[x]
            own = block[x:y]
            left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i >= 0 else (np.arange(y - x),) * 2
            out += [(int(c[x + a]), int(c[x + b])) for a, b in exact_links(rows, local, left, right, percent, signature[x:y])]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return confirm


def document_key(id_col: str, text_col: str) -> list:
    """(d, t): a row's id, null ordered after all others so that it never represents a group with another id; its text's hash."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text_col).alias("t")]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = 75) -> DataFrame:
    """(d, t, n, component, label): one row for each row of docs, by its key; component is the smallest id of its group.

    label tells groups apart, also those of unlike texts without an id or with the same one; null for rows without words.
    percent: links need 100 * |intersection| >= percent * |union| of the shingle sets (70 to 100: the signature
    distance that the join guarantees is set for 75 and more).
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must lie between 70 and 100")
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text"))
    sets = stored(keyed.mapInArrow(_set_rows(k), SETS), "near-sets")
    n_sets = sets.count()
    classes = sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("d", "t", "signature")).alias("m"))
    # the class id is its smallest id; texts of one id that differ are told apart by their hash
    classes = stored(classes.select("s1", "s2", "n", "m.d", "m.t", "m.signature", F.xxhash64("m.d", "s1", "s2").alias("c")), "near-classes", tasks=-(-n_sets // FILE_ROWS))
    n_classes = classes.count()
    group = components(candidate_links(classes, parts), "near-candidates")

    member = classes.select("c", "d", "t", "n", "signature").join(group.select(F.col("node").alias("c"), F.col("label").alias("g")), "c")
    size = member.groupBy("g").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    member = join_spread(member, size, ["g"], n_classes).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    member = stored(member.select("g", "c", "d", "t", "n", "signature", "blocks", "block"), "near-members", group.count())
    small = max(1, (member.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // (2 * BLOCK_SHINGLES))
    # a group of one block shares a task with others; in a larger one each pair of blocks is a task
    one = F.array(F.struct(F.pmod(F.xxhash64("g"), F.lit(small)).alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    # a row that repeats an id and its text is one set
    texts = V.packed(keyed).join(member.drop("n").hint("merge"), ["d", "t"]).dropDuplicates(["d", "t"])
    dealt = texts.select("g", "c", "signature", "block", "z", "size", F.explode(F.when(F.col("blocks") == 1, one).otherwise(_block_pairs(F.col("g")))).alias("p")).select("g", "c", "signature", "block", "z", "size", "p.*")
    links = dealt.groupBy("task", "i", "j").applyInArrow(_confirm(k, percent), "a long, b long")
    joined = components(links, "near-links")

    reach = classes.select("s1", "s2", "n", "c", "d").join(joined, F.col("c") == F.col("node"), "left").withColumn("label", F.coalesce("label", "c"))
    smallest = reach.groupBy("label").agg(F.min("d").alias("component"))
    reach = stored(join_spread(reach, smallest, ["label"], n_classes).select("s1", "s2", "n", "component", "label"), "near-reach", n_classes)
    out = join_spread(sets.where("n > 0").select("d", "t", "s1", "s2", "n"), reach, ["s1", "s2", "n"], n_sets).select("d", "t", "n", "component", "label")
    empty = sets.where("n = 0").select("d", "t", "n", F.col("d").alias("component"), F.lit(None).cast("long").alias("label"))
    return compact(out.unionByName(empty), scan_tasks(sets))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = 75) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id of its group), kept."""
    out = groups(docs, id_col, text_col, k, percent)
    known = lambda x: F.when(F.col(x) != NO_ID, F.col(x))
    return out.select(known("d").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"), (F.col("d") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = 75) -> DataFrame:
    """docs with one row of each group: that of the smallest id. Rows without words stay, but for repeats of a row."""
    docs = docs.drop("_d", "_t", "_n")
    found = groups(docs, id_col, text_col, k, percent)
    first = found.where("n > 0").groupBy("label").agg(F.min(F.struct("d", "t")).alias("m")).select("m.d", "m.t")
    keep = first.unionByName(found.where("n = 0").select("d", "t")).distinct()
    names = docs.columns
    d, t = document_key(id_col, text_col)
    rows = docs.select("*", d.alias("_d"), t.alias("_t")).join(keep.select(F.col("d").alias("_d"), F.col("t").alias("_t")), ["_d", "_t"])
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_t").orderBy(F.lit(0)))).where("_n = 1").select(*names)
    return compact(rows, scan_tasks(docs))
