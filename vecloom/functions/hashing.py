"""64-bit hashes in numpy (Spark's ANSI arithmetic raises on overflow), hyperplanes, half precision."""

from __future__ import annotations

import numpy as np

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 generator's output for state x."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, dtype=np.uint64) + GOLDEN
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


def sample_score(ids: np.ndarray, seed: int) -> np.ndarray:
    """Deterministic score of ids; the k smallest are a sample that doesn't depend on order."""
    with np.errstate(over="ignore"):
        return splitmix64(U(seed & (2**64 - 1)) ^ (np.asarray(ids).astype(np.uint64) * GOLDEN))


#: Factor of the size, and rotations of the first, middle and last id, in a leaf's name.
ROUTE_FACTOR, ROUTE_ROTATIONS = 0xD6E8FEB86659FD93, (7, 17, 29)


def route_family(ids: np.ndarray) -> int:
    """A stable non-zero 32-bit name of a leaf, from its size and its first, middle and last id."""
    n = len(ids)
    rotate = lambda x, r: ((x << r) | (x >> (64 - r))) & (2**64 - 1)
    named = (int(ids[0]), int(ids[n // 2]), int(ids[-1])) if n else (0, 0, 0)
    seed = n * ROUTE_FACTOR & (2**64 - 1)
    for x, r in zip(named, ROUTE_ROTATIONS, strict=True):
        seed ^= rotate(x, r)
    return max(1, int(splitmix64(np.array([seed], dtype=np.uint64))[0]) & 0xFFFFFFFF)


def hyperplanes(dims: int, m: int, seed: int = 42) -> np.ndarray:
    """m random directions with components in [-1, 1)."""
    return np.random.Generator(np.random.PCG64(seed)).uniform(-1, 1, (m, dims)).astype(np.float32)


def fixed_hyperplanes(dims: int, m: int) -> np.ndarray:
    """Directions by a closed formula, so that any SQL engine can rebuild them."""
    i, j = np.arange(m)[:, None], np.arange(dims)[None, :]
    return ((i * 31 + j * 17 + i * j * 7) % 101) / 50.0 - 1.0


def truncate_bf16(x: np.ndarray) -> np.ndarray:
    """Keep the 16 high bits of single precision."""
    return (np.asarray(x, np.float32).view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32)
