"""numpy kernels: exact distances in index order, bounded top-k, sampled-dimension pruning."""

from __future__ import annotations

import numpy as np


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|a| x |b| squared distances, summed in index order in double: the same bits as the column expressions."""
    out = np.zeros((len(a), len(b)))
    left, right = a.T.astype(np.float64), b.T.astype(np.float64)
    for x, y in zip(left, right, strict=True):
        d = x[:, None] - y[None, :]
        d *= d
        out += d
    return out


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, columns of its k smallest values by (value, id), and which entries are real (not infinite)."""
    k = min(k, d.shape[1])
    if not k:
        return np.zeros((len(d), 0), np.int64), np.zeros((len(d), 0), bool)
    limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    rows, columns = np.nonzero(d <= limit)
    order = np.lexsort((ids[columns], d[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(len(d)))
    take = first[:, None] + np.arange(k)
    best = columns[take]
    return best, np.isfinite(np.take_along_axis(d, best, axis=1))


def top_k(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None, block: int = 256):
    """(row of a, row of b, distance, rank from 1): k nearest rows of b for each row of a, ties by id; own ids are left out."""
    out = []
    for s in range(0, len(a), block):
        d = squared_distances(a[s : s + block], b)
        if own is not None:
            d[own[s : s + block, None] == ids[None, :]] = np.inf
        best, real = smallest(d, ids, k)
        r, c = np.nonzero(real)
        out.append((r + s, best[r, c], d[r, best[r, c]], c + 1))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0), z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def ratio_table(dims: int, epsilon: float, group: int) -> tuple[np.ndarray, np.ndarray]:
    """After each group of dimensions: how many were seen, and the share of the threshold that keeps a candidate."""
    if dims <= 0 or group <= 0 or not np.isfinite(epsilon) or epsilon <= 0:
        raise ValueError("dims and group must be positive, epsilon finite and positive")
    seen = np.minimum(np.arange(group, dims + group, group), dims)
    ratio = seen / dims * (1 + epsilon / np.sqrt(seen)) ** 2
    return seen, np.where(seen >= dims, 1.0, ratio)


def sampled_top_k(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, epsilon: float, group: int, seeds: int = 8, own: np.ndarray | None = None):
    """top_k with early abandoning: a candidate goes when its partial distance reaches the current k-th distance times the ratio.

    An approximation; exact for a large epsilon. Dimensions should be rotated first. Returns top_k's columns and the share of
    distance terms that was computed.
    """
    seen, ratio = ratio_table(a.shape[1], epsilon, group)
    out, work = [], 0
    for i in range(len(a)):
        rows = np.arange(len(b)) if own is None else np.flatnonzero(ids != own[i])
        start = rows[: max(seeds, k, 1)]
        have = squared_distances(a[i : i + 1], b[start])[0]
        limit = np.sort(have)[k - 1] if len(have) >= k else np.inf
        rest, partial, low = rows[len(start) :], np.zeros(max(len(rows) - len(start), 0)), 0
        for s, r in zip(seen.tolist(), ratio.tolist(), strict=True):
            for j in range(low, s):
                d = float(a[i, j]) - b[rest, j].astype(np.float64)
                partial += d * d
            work += len(rest) * (s - low)
            low, keep = s, partial < limit * r if s < a.shape[1] else partial <= limit
            rest, partial = rest[keep], partial[keep]
        rows, d = np.r_[start, rest], np.r_[have, partial]
        best = np.lexsort((ids[rows], d))[:k]
        out.append((np.full(len(best), i), rows[best], d[best], np.arange(1, len(best) + 1)))
    if not out:
        z = np.zeros(0, np.int64)
        return (z, z, np.zeros(0), z), 0.0
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)), work / max(1, len(a) * len(b) * a.shape[1])
