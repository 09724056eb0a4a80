"""Vector algebra as column expressions: sums run in index order in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _total(F.zip_with(_c(a), _c(b), term))


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(a: Column | str) -> Column:
    return _total(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")))


def residual(a: Column | str, centre: Column | str, subtract: bool = True) -> Column:
    sign = -1.0 if subtract else 1.0
    return F.zip_with(_c(a), _c(centre), lambda x, y: x.cast("double") + F.lit(sign) * y.cast("double"))


def sketch(vector: Column | str, planes: Sequence[Sequence[float]]) -> Column:
    """Projections on fixed hyperplanes (a bounded literal)."""
    return F.array(*[dot(vector, F.array(*[F.lit(float(x)) for x in row])) for row in planes])


def residual_hash(source: Column | str, target: Column | str) -> Column:
    """Bit i is set where the target's projection is not below the source's."""
    bits = F.zip_with(_c(target), _c(source), lambda t, s: F.when(t - s >= 0, F.lit(1)).otherwise(F.lit(0)))
    return F.aggregate(F.reverse(bits), F.lit(0), lambda h, b: h * 2 + b)


def pruning_ratio(visited: Column | str, dims: int, epsilon: float) -> Column:
    """Share of a distance that `visited` of `dims` dimensions should have reached: 1 at both ends."""
    v = _c(visited).cast("double")
    grown = F.lit(1.0) + F.lit(float(epsilon)) / F.sqrt(v)
    return F.when((v <= 0) | (v >= dims), F.lit(1.0)).otherwise(v / F.lit(float(dims)) * grown * grown)


#: Fixed value: squared distances must differ by this factor before an edge counts as shaded by another.
SHADE = 1.2


def is_shaded(source_victim: Column | str, pivot_victim: Column | str) -> Column:
    return _c(pivot_victim) < _c(source_victim) / F.lit(SHADE)


def shade_margin(source_victim: Column | str, pivot_victim: Column | str) -> Column:
    """How far a pivot lies inside the limit, as 16 bits."""
    limit = _c(source_victim) / F.lit(SHADE)
    share = F.when(limit > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (limit - _c(pivot_victim)) / limit))).otherwise(F.lit(0.0))
    return F.floor(share * 65535 + F.lit(0.5)).cast("int")


def witness_key(pivot_rank: Column | str, margin: Column | str, victim_rank: Column | str) -> Column:
    """Smaller is better: near pivots, then wide margins, then near victims."""
    return _c(pivot_rank).cast("long") * (1 << 24) + (F.lit(65535) - _c(margin)).cast("long") * 256 + _c(victim_rank).cast("long")


def rank_weight(rank: Column | str) -> Column:
    """6, 3, 2 for the first three ranks, then 1."""
    r = _c(rank)
    return F.when(r <= 1, 6).when(r == 2, 3).when(r == 3, 2).otherwise(1)


#: The two factors and the rotation that choose a view family's bit.
FAMILY_FACTORS, FAMILY_ROTATION = (0x9E3779B1, 0x85EBCA6B), 13


def family_bit(family: Column | str) -> Column:
    """Which of 64 bits a view family sets: two 32-bit multiplications with a rotation between, low six bits.

    Products go through two halves of the factor, so they stay within 63 bits.
    """

    def times(x: Column, factor: int) -> Column:
        high, low = factor >> 16, factor & 0xFFFF
        return ((x * high % (1 << 32)) * (1 << 16) + x * low) % (1 << 32)

    x = times(F.pmod(_c(family).cast("long"), F.lit(1 << 32)), FAMILY_FACTORS[0])
    x = (x * (1 << FAMILY_ROTATION)) % (1 << 32) + F.floor(x / (1 << (32 - FAMILY_ROTATION))).cast("long")
    return times(x, FAMILY_FACTORS[1]).bitwiseAND(63).cast("int")
