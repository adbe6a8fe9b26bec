"""Vector algebra as Column expressions over array<double>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS, STD_FLOOR = 1e-12, 1e-6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def l2_normalize(v: Column) -> Column:
    """v divided by its norm, which counts as EPS at least; a zero vector stays zero."""

    def scaled(a):
        return let(F.greatest(F.sqrt(dot(a, a)), F.lit(EPS)), lambda n: F.transform(a, lambda x: x / n))

    return let(v, scaled)


def cosine_distance(a: Column, b: Column, clip: bool = True) -> Column:
    """1 - a.b of unit vectors, the product held within [-1, 1] if ``clip``."""
    d = dot(a, b)
    return 1 - (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d)) if clip else d)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def row_zscore(s: Column) -> Column:
    """Per-row standard score (population deviation, floored), then unit length."""

    def centred(d):  # d: differences from the mean
        spread = F.greatest(F.sqrt(total(F.transform(d, lambda x: x * x)) / F.size(d)), F.lit(STD_FLOOR))
        return let(spread, lambda sd: F.transform(d, lambda x: x / sd))

    return l2_normalize(let(let(s, lambda a: let(mean(a), lambda m: F.transform(a, lambda x: x - m))), centred))


def _places(s: Column) -> Column:
    """Positions from the largest value to the smallest, equal values by position."""
    return F.transform(F.array_sort(F.transform(s, lambda x, k: F.struct((-x).alias("v"), k.alias("k")))), lambda p: p["k"])


def rank_transform(s: Column) -> Column:
    """1 for the largest value down to 0 for the smallest, then unit length."""

    def ranks(a):
        span = F.greatest(F.lit(1), F.size(a) - 1)
        return let(_places(a), lambda order: F.transform(a, lambda x, k: 1.0 - (F.array_position(order, k) - 1) / span))

    return l2_normalize(let(s, ranks))


def softmax(s: Column, temperature: float) -> Column:
    return l2_normalize(let(s, lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp((x - top) / temperature)))))


def keep_largest(s: Column, k: int, binary: bool = False) -> Column:
    """The k largest values (or 1.0) and zeros elsewhere, then unit length."""

    def kept(a):
        return let(F.slice(_places(a), 1, k), lambda some: F.transform(a, lambda x, p: F.when(F.array_contains(some, p), F.lit(1.0) if binary else x).otherwise(0.0)))

    return l2_normalize(let(s, kept))


def weighted(s: Column, weights: Column) -> Column:
    return F.zip_with(s, weights, lambda x, w: x * w)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
