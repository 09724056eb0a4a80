"""Language-model scoring by prediction by partial matching (PPM) with exclusion, pretrained on the corpus.

A text is the byte stream of its tokens: lower-cased words with one space between
them, then one end byte. Each byte is predicted from the ORDER bytes before it,
across words and spaces; before a text's first byte stand end bytes. A byte not
seen in a context escapes to the next shorter one (PPMD: each distinct byte seen
gives half a count to the escape) where bytes of the longer context are excluded;
after order 0 the bytes never seen are equally likely.

1. Texts are packed into blocks of bounded size, one row each, and stored.
2. A block sums up its distinct grams (context and byte, one 64-bit integer with
   the latest context byte first, so that sorting them walks the trie of contexts)
   and asks for their code lengths. The trie is dealt to parts: ranges of sorted
   grams that never split contexts with a common suffix. Suffixes are grown byte by
   byte while more than PART_GRAMS bytes of the corpus follow them, so a frequent
   suffix is spread too; the counts of the shorter contexts above such a cut are
   broadcast (at most 256 for each suffix that is grown, fewer than one suffix for
   PART_GRAMS bytes and order).
3. A part adds up the counts of all blocks and answers each block in the order in
   which its grams came: counts of grams that training texts hold, what the block
   lacks of their contexts' sums, and the code lengths of the others.
4. Blocks look up their bytes and sum by text. Words go the same way to their counts.

Counts cover all training texts. Nothing but sums and tables of bounded size
reaches the driver: 65,536 counts of byte pairs and those of the grown suffixes.
A block is cut by its bytes, but for a single longer text.

Null, empty, repeated: a null text is empty: one end token; rows with the same id
are scored each; without training rows all bytes are equally likely and no token
is known; an empty table gives an empty result. Further columns are carried along;
those named like the added ones are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .runtime import bounded_batches, stored

ORDER = 7  # a gram fills 64 bits
#: Text that one block is planned to hold, bytes of the corpus that one part of the trie and one part of the words are planned for.
BLOCK_BYTES, PART_GRAMS, PART_BYTES = 8 << 20, 12_000_000, 32_000_000
_PIECE = 1 << 20
_END, _BLANK = 0x0A, 0x20
U64 = np.uint64
ASKED = "part int, block long, n long, keys binary, counts binary"
REPLY = "block long, part int, kind int, n long, contexts long, unseen long, counts binary, more binary, costs binary"


def streams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte streams of texts, and their offsets: lower case, one space between words, an end byte last."""
    n = len(off) - 1
    close = off[1:] + np.arange(n)  # where the end bytes go
    raw = np.empty(len(data) + n, np.uint8)
    text = np.ones(len(raw), bool)
    text[close] = False
    raw[text], raw[close] = data, _END
    space = V.SPACE[raw]
    low = np.where(space, np.uint8(_BLANK), V.LOWER[raw])
    keep = ~space
    keep[1:] |= keep[:-1]  # the first white byte after a word
    keep[close] = True
    low[close] = _END
    doc = np.cumsum(np.add.reduceat(keep, np.r_[0, close[:-1] + 1]) if n else np.zeros(0, np.int64))
    out = low[keep]
    # a space right before the end byte goes
    drop = doc - 2
    drop = drop[(drop >= np.r_[0, doc[:-1]]) & (out[np.maximum(drop, 0)] == _BLANK)] if n else drop
    stay = np.ones(len(out), bool)
    stay[drop] = False
    sizes = np.diff(np.r_[0, doc]) - np.isin(doc - 2, drop)
    return out[stay], np.r_[0, np.cumsum(sizes)].astype(np.int64)


def grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The gram of each byte of streams laid end to end: the ORDER bytes before it, the latest first, then the byte."""
    out = np.empty(len(data), U64)
    padded = np.r_[np.full(ORDER, _END, np.uint8), data]
    for i in range(0, len(data), _PIECE):
        m = min(_PIECE, len(data) - i)
        x = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded[i : i + m + ORDER], ORDER + 1)).view("<u8")[:, 0]
        out[i : i + m] = (x << U64(8)) | (x >> U64(56))
    first, size = off[:-1], np.diff(off)
    for j in range(ORDER):  # contexts don't reach back into the text before
        at = first[size > j] + j
        filler = int.from_bytes(bytes([0] * j + [_END] * (ORDER - j) + [0]), "big")
        keep = int.from_bytes(bytes([255] * j + [0] * (ORDER - j) + [255]), "big")
        out[at] = (out[at] & U64(keep)) | U64(filler)
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each occurs; x is sorted in place."""
    x.sort()
    at = _runs(x)
    return x[at], np.diff(np.r_[at, len(x)])


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _prefix(gram: np.ndarray, order: int) -> np.ndarray:
    """The `order` latest bytes of the contexts of grams."""
    return gram >> U64(64 - 8 * order) if order else np.zeros(len(gram), U64)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among sorted ones, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _Order:
    """Counts of one order: sorted keys (context, byte) that were seen, and by context their sum, number and mass one order below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: _Order | None):
        self.keys, self.counts = keys, counts.astype(np.int64)
        context = keys >> U64(8)
        first = _runs(context)
        self.contexts = context[first]
        total = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)
        self.n, self.t = total(self.counts), np.diff(np.r_[first, len(keys)])
        if below is None:
            self.x = np.zeros(len(first), np.int64)
        else:
            at, found = _lookup(below.keys, shorter(keys))
            self.x = total(np.where(found, below.counts[at], 0) if len(below.keys) else np.zeros(len(keys), np.int64))


def shorter(keys: np.ndarray) -> np.ndarray:
    """Keys (context, byte) without the oldest byte of the context."""
    return ((keys >> U64(16)) << U64(8)) | (keys & U64(255))


def code_lengths(gram: np.ndarray, count: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of the last byte of each gram given those before it.

    gram: sorted and distinct, all that share any one's len(low) latest context bytes; count: of training.
    low: (keys, counts) of the orders 0, 1, .. that these grams alone can't tell.
    """
    seen = count > 0
    tables = {ORDER: (gram[seen], count[seen].astype(np.int64))}
    for o in range(ORDER - 1, len(low) - 1, -1):
        keys, counts = tables[o + 1]
        keys = shorter(keys)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = _runs(keys)
        tables[o] = keys[first], (np.add.reduceat(counts, first) if len(first) else counts)
    for o, table in enumerate(low):
        tables[o] = table
    orders: list[_Order] = []
    for o in range(ORDER + 1):
        orders.append(_Order(*tables[o], orders[-1] if o else None))

    out = np.zeros(len(gram))
    rows = np.arange(len(gram))
    gone_n, gone_t = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    for o in range(ORDER, -1, -1):
        if not len(rows):
            break
        t = orders[o]
        context = _prefix(gram[rows], o)
        at, known = _lookup(t.contexts, context)
        total, kinds, mass = ((np.where(known, v[at], 0) if len(v) else np.zeros(len(rows), np.int64)) for v in (t.n, t.t, t.x))
        at, found = _lookup(t.keys, (context << U64(8)) | (gram[rows] & U64(255)))
        own = np.where(found, t.counts[at], 0) if len(t.counts) else np.zeros(len(rows), np.int64)
        open_n, open_t = total - gone_n, kinds - gone_t
        active = open_n > 0
        out[rows[active]] += np.log10(np.where(own > 0, 2 * own - 1, open_t)[active] / (2 * open_n)[active])
        left = ~(active & (own > 0))
        gone_n, gone_t = np.where(known, mass, gone_n)[left], np.where(known, kinds, gone_t)[left]
        rows = rows[left]
    out[rows] -= np.log10(np.maximum(256 - gone_t, 1))
    return out


def _planes(x: np.ndarray) -> bytes:
    """Compressed array: first bytes of all values, then their second ones, and so on."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.Codec("zstd", compression_level=1).compress(raw.tobytes(), asbytes=True)


def _unplanes(z, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize * n
    raw = np.frombuffer(pa.Codec("zstd").decompress(z, size, asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=U64(0)))


def _unpack_sorted(z, n: int) -> np.ndarray:
    return np.cumsum(_unplanes(z, "<u8", n), dtype=U64)


def _word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc = V.words(data, off)
    return V.span_hash(V.prefix_sums(data), start, end), doc


def _make_blocks(names: list[str], limit: int):
    """Rows -> blocks: training texts first."""

    def block(key: int, rows: list[pa.RecordBatch], texts: list[bytes]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        train = table["_train"].to_numpy(zero_copy_only=False)
        order = np.argsort(~train, kind="stable")
        table = table.take(pa.array(order))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        raw = b"".join([texts[i] for i in order])
        n_train = int(train.sum())
        columns = [table[c].combine_chunks() for c in names]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        docs = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.StructArray.from_arrays(columns, names=names))
        one = lambda x, kind=None: pa.array([x], kind)
        return pa.RecordBatch.from_arrays(
            [one(key), docs, one(sizes.astype("<i8").tobytes()), one(n_train, pa.int64()), one(pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)), one(len(raw), pa.int64())],
            ["block", "docs", "sizes", "n_train", "z", "size"],
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key, rows, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            if not len(batch):
                continue
            text, off = V.arrow_text(batch.column(batch.schema.get_field_index("_text")))
            for i, j, part, o in V.blocks(text, off, _PIECE):
                stream, at = streams(part, o)
                raw = stream.tobytes()
                texts += [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                rest = batch.select(names).slice(i, j - i)
                rows.append(rest)
                held += len(raw) + rest.nbytes
                if held >= limit:
                    yield block(key, rows, texts)
                    key, rows, texts, held = key + 1, [], [], 0
        if texts:
            yield block(key, rows, texts)

    return blocks


def _open(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(block, streams, offsets, training texts) of each row."""
    for row in range(len(batch)):
        get = lambda c: batch.column(batch.schema.get_field_index(c))[row]  # noqa: B023, E731
        sizes = np.frombuffer(get("sizes").as_buffer(), "<i8")
        data = np.frombuffer(pa.Codec("zstd").decompress(get("z").as_buffer(), get("size").as_py(), asbytes=True), np.uint8)
        yield get("block").as_py(), data, np.r_[0, np.cumsum(sizes)], get("n_train").as_py()


def _pieces(data: np.ndarray, off: np.ndarray, n_train: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Grams of a run of texts, and whether these are for training."""
    for a, b, train in ((0, n_train, True), (n_train, len(off) - 1, False)):
        for _, _, x, at in V.blocks(data[off[a] : off[b]], off[a : b + 1] - off[a], _PIECE):
            yield grams(x, at), train


def _sums(level: int, grown: np.ndarray | None):
    """Sums of a task: kind 0, (context of `level` - 1 bytes, byte) over training texts; kind 1, suffixes of `level` bytes over all; only below `grown`."""
    if grown is not None:
        near = np.zeros(1 << 16, bool)  # by the two latest bytes of suffixes that are grown
        near[(grown >> U64(8 * (level - 3))).astype(np.int64)] = True

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros((2, 1 << 16), np.int64)
        have = [(np.zeros(0, U64), np.zeros(0, np.int64))] * 2

        def add(kind: int, keys: np.ndarray) -> None:
            if grown is None:  # two bytes
                flat[kind] += np.bincount(keys.astype(np.int64), minlength=1 << 16)
            else:
                k, n = _distinct(keys)
                unique, inverse = np.unique(np.concatenate([have[kind][0], k]), return_inverse=True)
                have[kind] = unique, np.bincount(inverse, weights=np.concatenate([have[kind][1], n]), minlength=len(unique)).astype(np.int64)

        for batch in batches:
            for _, data, off, n_train in _open(batch):
                for g, train in _pieces(data, off, n_train):
                    if grown is not None:
                        g = g[near[_prefix(g, 2).astype(np.int64)]]
                        g = g[_lookup(grown, _prefix(g, level - 1))[1]]
                    if train:
                        add(0, (_prefix(g, level - 1) << U64(8)) | (g & U64(255)))
                    add(1, _prefix(g, level))
        for kind in (0, 1):
            keys, n = (np.flatnonzero(flat[kind]), flat[kind][flat[kind] > 0]) if grown is None else have[kind]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], ["kind", "key", "n"])

    return sums


def _sorted_table(rows: list) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(rows)
    return np.array([k for k, _ in rows], U64), np.array([n for _, n in rows], np.int64)


def plan_trie(blocks: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(first gram, suffix length) of each part, and counts by order above the parts. least: parts that there should be; most: bytes a part is planned for."""
    def level(k: int, grown: np.ndarray | None) -> tuple[list, list]:
        rows = blocks.mapInArrow(_sums(k, grown), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()  # 256 for each suffix that is grown
        return [(r[1], r[2]) for r in rows if r[0] == 0], [(r[1], r[2]) for r in rows if r[0] == 1]

    counts, suffixes = level(2, None)
    single = defaultdict(int)
    for k, n in counts:
        single[k & 255] += n
    low = [_sorted_table(list(single.items())), _sorted_table(counts)]
    total = sum(n for _, n in suffixes)
    fair = max(1, min(most, total // (2 * least)))
    parts: list[tuple[int, int]] = []
    by_level = {2: sorted(suffixes)}
    for k in range(2, ORDER):
        grown = [s for s, n in by_level[k] if n > most]
        if not grown:
            break
        counts, suffixes = level(k + 1, np.array(grown, U64))
        low.append(_sorted_table(counts))
        by_level[k + 1] = sorted(suffixes)

    def walk(k: int, items: list) -> None:
        held = fair  # the first suffix opens a part
        for s, n in items:
            if k < ORDER and n > most:
                walk(k + 1, [(c, m) for c, m in by_level[k + 1] if c >> 8 == s])
                held = fair
                continue
            if held >= fair:
                parts.append((s << (64 - 8 * k), k))
                held = 0
            held += n

    walk(2, by_level[2])
    parts.sort()
    parts = parts or [(0, 2)]
    return np.array([p for p, _ in parts], U64), np.array([k for _, k in parts]), low


def _ask(parts: Callable[[], np.ndarray], distinct: Callable):
    """Sorted distinct keys of each block with their training counts, dealt to parts by where these begin."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = parts()[1:]
        for batch in batches:
            for block, data, off, n_train in _open(batch):
                keys, counts = distinct(data, off, n_train)
                cuts = np.r_[0, np.searchsorted(keys, starts), len(keys)]
                have = np.flatnonzero(np.diff(cuts))
                for i in range(0, len(have), 64):
                    ps = have[i : i + 64].tolist()
                    spans = [slice(int(cuts[p]), int(cuts[p + 1])) for p in ps]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ps, pa.int32()), pa.array([block] * len(ps), pa.int64()), pa.array([x.stop - x.start for x in spans], pa.int64()), pa.array([_pack_sorted(keys[x]) for x in spans], pa.binary()), pa.array([_planes(counts[x]) for x in spans], pa.binary())],
                        ["part", "block", "n", "keys", "counts"],
                    )

    return ask


def _block_grams(data: np.ndarray, off: np.ndarray, n_train: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of a block and how often its training texts hold them."""
    cut = off[n_train]
    own, count = _distinct(grams(data[:cut], off[: n_train + 1]))
    other, _ = _distinct(grams(data[cut:], off[n_train:] - cut))
    if not len(other):
        return own, count.astype(np.uint32)
    gram, _ = _distinct(np.concatenate([own, other]))
    out = np.zeros(len(gram), np.uint32)
    out[np.searchsorted(gram, own)] = count
    return gram, out


def _sorted_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a block in ascending order, where each distinct one begins, and the place and text of each."""
    got = [(np.zeros(0, U64), np.zeros(0, np.int64))]
    for i, _, part, o in V.blocks(data, off, _PIECE):
        h, doc = _word_hashes(part, o)
        got.append((h, doc + i))
    h, doc = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(h)
    h = h[order]
    return h, _runs(h), order, doc


def _block_words(data: np.ndarray, off: np.ndarray, n_train: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word hashes of a block and how often its training texts hold them."""
    h, first, order, doc = _sorted_words(data, off)
    return h[first], (np.add.reduceat((doc < n_train)[order].astype(np.uint32), first) if len(first) else np.zeros(0)).astype(np.uint32)


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Distinct keys of a part, their counts over all blocks, and where each block's keys are."""
    size, z, c = table["n"].to_numpy(), table["keys"].combine_chunks(), table["counts"].combine_chunks()
    keys = [_unpack_sorted(z[i].as_buffer(), int(n)) for i, n in enumerate(size)]
    unique, _ = _distinct(np.concatenate(keys))
    total, places = np.zeros(len(unique), np.int64), []
    for i, n in enumerate(size):
        at = np.searchsorted(unique, keys[i]).astype(np.int32)
        total[at] += _unplanes(c[i].as_buffer(), "<u4", int(n))
        keys[i] = None
        places.append((table["block"][i].as_py(), at))
    return unique, total, places


def _reply(part: int, kind: int, rows: list[tuple]) -> pa.Table:
    """rows: block, counts, what is more in the contexts, code lengths of what wasn't seen."""
    blocks, counts, more, costs = zip(*rows, strict=True)
    full = lambda x: pa.array(np.full(len(rows), x, np.int32))
    sizes = [pa.array([len(x) for x in v], pa.int64()) for v in (counts, more, costs)]
    return pa.table([pa.array(blocks, pa.int64()), full(part), full(kind), *sizes, *(pa.array([_planes(x) for x in v], pa.binary()) for v in (counts, more, costs))], ["block", "part", "kind", "n", "contexts", "unseen", "counts", "more", "costs"])


def _trie_part(shared):
    def costs(table):
        part = table["part"][0].as_py()
        _, depth, low = shared.value
        gram, count, places = _added(table)
        cost = code_lengths(gram, count, low[: depth[part]])
        context = gram >> U64(8)
        first = _runs(context)
        total = np.repeat(np.add.reduceat(count, first), np.diff(np.r_[first, len(gram)]))

        def answer(block, at):
            c, own = count[at], _runs(context[at])
            return block, c, total[at[own]] - np.add.reduceat(c, own), cost[at[c == 0]]

        return _reply(part, 0, [answer(*x) for x in places])

    return costs


def _word_part(table):
    _, count, places = _added(table)
    none = np.zeros(0, np.int64)
    out = _reply(table["part"][0].as_py(), 1, [(block, count[at], none, none) for block, at in places])
    return out.append_column("known", pa.array([int((count > 0).sum())] + [0] * (len(out) - 1), pa.int64())).append_column("total", pa.array([int(count.sum())] + [0] * (len(out) - 1), pa.int64()))


def _gathered(replies: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What came back to a block, in the order of its sorted keys."""
    mine = replies.filter(pa.array(replies["kind"].to_numpy() == kind))
    order = np.argsort(mine["part"].to_numpy()).tolist()

    def values(column: str, size: str, dtype: str) -> np.ndarray:
        z, n = mine[column].combine_chunks(), mine[size].to_numpy()
        return np.concatenate([np.zeros(0, dtype), *(_unplanes(z[i].as_buffer(), dtype, int(n[i])) for i in order)])

    return values("counts", "n", "<i8"), values("more", "contexts", "<i8"), values("costs", "unseen", "<f8")


def _block_costs(gram: np.ndarray, count: np.ndarray, more: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """Code lengths of a block's distinct grams."""
    first = _runs(gram >> U64(8))
    total = np.repeat(np.add.reduceat(count, first) + more, np.diff(np.r_[first, len(gram)]))
    out = np.empty(len(gram))
    seen = count > 0
    out[seen] = np.log10((2 * count[seen] - 1) / (2 * total[seen]))
    out[~seen] = unseen
    return out


def _score_block(names: list[str], total: int, distinct: int, ends: int):
    base, end = np.log10(total + distinct + 1), np.log10(ends + 1.0)

    def score(blocks, replies):
        out = []
        for batch in blocks.combine_chunks().to_batches():
            for row, (_, data, off, n_train) in enumerate(_open(batch)):
                out.append(_scores(batch, row, data, off, n_train, replies))
        return pa.concat_tables(out)

    def _scores(batch, row, data, off, n_train, replies):
        gram = _block_grams(data, off, n_train)[0]
        cost = _block_costs(gram, *_gathered(replies, 0))
        n = len(off) - 1
        h, first, order, doc = _sorted_words(data, off)
        trained = np.empty(len(h), np.int64)
        trained[order] = np.repeat(_gathered(replies, 1)[0], np.diff(np.r_[first, len(h)]))
        del h, order
        tokens = 1 + np.bincount(doc, minlength=n)
        known = np.bincount(doc, weights=trained > 0, minlength=n)
        base_sum = np.bincount(doc, weights=np.log10(trained + 1.0), minlength=n)
        ppm = np.zeros(n)
        for i, j, part, o in V.blocks(data, off, _PIECE):
            g = grams(part, o)
            order = np.argsort(g)
            g = g[order]
            first = _runs(g)
            own = np.empty(len(g))
            own[order] = np.repeat(cost[np.searchsorted(gram, g[first])], np.diff(np.r_[first, len(g)]))
            ppm[i:j] = np.add.reduceat(own, o[:-1])  # no stream is empty
        known += ends > 0
        flat = batch.column(batch.schema.get_field_index("docs"))[row].values
        columns = [flat.field(c) for c in names]
        return pa.table([*columns, pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(np.full(n, total)), pa.array(base_sum + end - tokens * base), pa.array(ppm)], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """docs (without the text) with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    train: which rows are learned from; null is no.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score", *(c for c in ("_train", "_text") if c != text_col))
    names = [c for c in docs.columns if c != text_col]
    rows = docs.select(*names, F.coalesce(train, F.lit(False)).alias("_train"), F.col(text_col).alias("_text"))
    kept = [*names, "_train"]
    kind = T.StructType().add("block", "long").add("docs", T.ArrayType(T.StructType([rows.schema[c] for c in kept]))).add("sizes", "binary").add("n_train", "long").add("z", "binary").add("size", "long")
    blocks = stored(rows.mapInArrow(_make_blocks(kept, BLOCK_BYTES), kind), "ppm-blocks")
    ends, size = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    slim = blocks.select("block", "sizes", "n_train", "z", "size")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    width = -(-(1 << 64) // max(tasks, -(-size // PART_BYTES)))  # of the hashes of a part
    words = slim.mapInArrow(_ask(lambda: np.arange(0, 1 << 64, width, dtype=object).astype(U64), _block_words), ASKED)
    words = stored(words.groupBy("part").applyInArrow(_word_part, REPLY + ", known long, total long"), "ppm-words")
    distinct, total = words.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    distinct, total = distinct + (ends > 0), total + ends

    shared = spark.sparkContext.broadcast(plan_trie(slim, tasks, PART_GRAMS))
    wanted = slim.mapInArrow(_ask(lambda: shared.value[0], _block_grams), ASKED)
    costs = wanted.groupBy("part").applyInArrow(_trie_part(shared), REPLY)
    replies = costs.unionByName(words.drop("known", "total"))
    schema = T.StructType([docs.schema[c] for c in names]).add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score_block(names, int(total), int(distinct), int(ends)), schema)
