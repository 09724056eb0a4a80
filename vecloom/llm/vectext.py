"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on one block of UTF-8 bytes (many documents laid end to end)
with numpy, so the cost per byte is a few dozen nanoseconds and memory is
bounded by the block size, never by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer single document forms its own block.
BLOCK_BYTES = 1 << 18

_MULT = U64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | U64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)

#: ASCII lower case; all other bytes stay as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True where a byte is white space: space, tab, LF, VT, FF, CR.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    """base**i modulo 2**64 for i < n (kept between calls)."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        step = np.full(size, U64(base), dtype=np.uint64)
        step[0] = 1
        have = _powers[key] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial sums; see span_hash."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data), "p"), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each [start, end); equal bytes, equal hash."""
    inverse = _power(_INVERSE, len(sums), "i")
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _MULT)


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of `width` bytes."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix((sums[width:] - sums[:n]) * _power(_INVERSE, n, "i"))


def arrow_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null is empty. No copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(data: np.ndarray, off: np.ndarray, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut documents into runs (first, last, bytes, offsets) of about `limit` bytes."""
    limit, i, n = limit or BLOCK_BYTES, 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the document of each; words never cross documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def shingle_hashes(word_hash: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of k words; a document of fewer words is one run."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])
    sums = np.zeros(len(word_hash) + 1, dtype=np.uint64)
    np.cumsum(word_hash * _power(_BASE, len(word_hash), "p"), out=sums[1:])
    n = len(word_hash) - k + 1
    out_doc, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if n > 0:
        ok = doc[:n] == doc[k - 1 :]
        at = np.flatnonzero(ok)
        out_doc.append(doc[at])
        out.append(span_hash(sums, at, at + k))
    short = np.flatnonzero((count > 0) & (count < k))
    out_doc.append(short)
    out.append(span_hash(sums, first[short], first[short + 1]))
    return np.concatenate(out_doc), np.concatenate(out)


def distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document, value)."""
    if not len(doc):
        return doc, value
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        data, off = arrow_text(batch.column(2))
        raw = memoryview(data)
        small = [codec.compress(raw[a:b], asbytes=True) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary()), pa.array(np.diff(off))], ["d", "t", "z", "size"])


def packed(keyed):
    """(d, t, text) -> (d, t, z, size) with compressed bytes: a third of what a shuffle of texts would write."""
    return keyed.mapInArrow(_pack, "d long, t long, z binary, size long")


def unpack(z: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of packed texts."""
    codec, sizes = pa.Codec("zstd"), size.tolist()
    parts = [codec.decompress(x.as_buffer(), n, asbytes=True) if n else b"" for x, n in zip(z, sizes, strict=True)]
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum(size)].astype(np.int64)
