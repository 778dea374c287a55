"""Similarity functions over array columns.

Each has a polarity: +1 if larger is better, -1 if smaller is better. Scores accumulate in double and
are returned as float. Short vectors of a known length are unrolled into plain arithmetic, which stays
inside generated code; longer ones use higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FLT_MAX = 3.4028234663852886e38
FLT_MIN_NORMAL = 1.1754943508222875e-38
UNROLL = 16


def is_normal(x: Column) -> Column:
    """Neither null, NaN, infinite, zero nor subnormal (as a float)."""
    x = x.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) >= FLT_MIN_NORMAL) & (F.abs(x) <= FLT_MAX), F.lit(False))


def is_normal_number(x: float) -> bool:
    """The same test for a Python number."""
    return FLT_MIN_NORMAL <= abs(x) <= FLT_MAX  # NaN fails


def _sum(a: Column, b: Column, term: Callable[[Column, Column], Column], dim: int | None) -> Column:
    if dim is not None and dim <= UNROLL:
        total = F.lit(0.0)
        for i in range(dim):
            total = total + term(F.get(a, F.lit(i)), F.get(b, F.lit(i)))
        return total
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def l1(a: Column, b: Column, dim: int | None = None) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y).cast("double"), dim).cast("float")


def l2(a: Column, b: Column, dim: int | None = None) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"), dim)).cast("float")


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    return _sum(a, b, lambda x, y: x.cast("double") * y.cast("double"), dim)


def cosine(a: Column, b: Column, dim: int | None = None) -> Column:
    """Cosine; -1 where it isn't a normal number (zero vectors, NaN, and exactly orthogonal vectors)."""
    v = dot(a, b, dim) / F.nullif(F.sqrt(dot(a, a, dim)) * F.sqrt(dot(b, b, dim)), F.lit(0.0))
    return F.when(is_normal(v), v).otherwise(-1.0).cast("float")


def hamming(a: Column, b: Column, dim: int | None = None) -> Column:
    """Different bits of packed words."""
    return _sum(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double"), dim).cast("float")


def type_hamming(a: Column, b: Column, dim: int | None = None) -> Column:
    """Different components."""
    return _sum(a, b, lambda x, y: (x != y).cast("double"), dim).cast("float")


def word_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    return (a != b).cast("float")


def weighted_l1(a: Column, b: Column, params: str) -> Column:
    """L1 with per-dimension weights given as the query's parameter string ``w0,w1,...`` (missing ones are 1)."""
    weights = F.transform(F.split(F.lit(params), ","), lambda w: F.coalesce(w.try_cast("double"), F.lit(1.0)))
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    return F.aggregate(F.zip_with(d, weights, lambda x, w: x * F.coalesce(w, F.lit(1.0))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).cast("float")


@dataclass(frozen=True)
class Similarity:
    name: str
    polarity: int
    apply: Callable[..., Column]

    def oriented(self, a: Column, b: Column, dim: int | None = None) -> Column:
        """Smaller is nearer, for index building."""
        return F.lit(-self.polarity) * self.apply(a, b, dim)


SIMILARITIES = {
    s.name: s
    for s in (
        Similarity("l1", -1, l1),
        Similarity("l2", -1, l2),
        Similarity("cosine", +1, cosine),
        Similarity("hamming", -1, hamming),
        Similarity("type_hamming", -1, type_hamming),
        Similarity("word", -1, word_distance),
    )
}
