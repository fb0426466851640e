"""Arrays of doubles as vectors, in Spark's higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * k)


def lerp(a: Column, b: Column, t: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * (1 - t) + y.cast("double") * t)


def slerp(a: Column, b: Column, t: float) -> Column:
    """Along the great circle, with the norm between; straight where a vector is zero or the two are nearly parallel."""
    na, nb = norm(a), norm(b)
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb))))
    wa, wb, n = F.sin((1 - t) * theta) / F.sin(theta), F.sin(t * theta) / F.sin(theta), na * (1 - t) + nb * t
    turned = F.zip_with(scaled(a, wa / na * n), scaled(b, wb / nb * n), lambda x, y: x + y)
    return F.when((na > 0) & (nb > 0), F.when(theta > 0.001, turned).otherwise(lerp(a, b, t))).otherwise(lerp(a, b, t))


def ties(a: Column, b: Column, density: float) -> Column:
    """Trims the smallest magnitudes, elects the sign by vote (a tie is negative) and averages what agrees."""

    def trimmed(v: Column) -> Column:
        sizes = F.array_sort(F.transform(v, lambda x: F.abs(x.cast("double"))))
        at = F.floor(F.size(v) * (1 - density)).cast("int")
        least = F.coalesce(F.try_element_at(sizes, at + 1), F.lit(0.0))
        return F.transform(v, lambda x: F.when(F.abs(x.cast("double")) >= least, x.cast("double")).otherwise(0.0))

    def elected(x: Column, y: Column) -> Column:
        up = (x > 0).cast("int") + (y > 0).cast("int")
        n = (x != 0).cast("int") + (y != 0).cast("int")
        sign = F.when(up > F.floor(n / 2.0), 1).otherwise(-1)
        agree = lambda v: v * sign > 0
        total = F.when(agree(x), F.abs(x)).otherwise(0.0) + F.when(agree(y), F.abs(y)).otherwise(0.0)
        count = agree(x).cast("int") + agree(y).cast("int")
        return F.when(count > 0, sign * total / count).otherwise(0.0)

    return F.zip_with(trimmed(a), trimmed(b), elected)


def crossover(a: Column, b: Column, key: Column, rate: float) -> Column:
    """Takes each component from b where a hash of key and place falls under rate: reruns agree."""
    at = F.sequence(F.lit(0), F.size(a) - 1)
    return F.transform(at, lambda i: F.when(F.pmod(F.crc32(F.concat_ws(":", key.cast("string"), i.cast("string")).cast("binary")), F.lit(1000)) < int(rate * 1000), F.get(b, i)).otherwise(F.get(a, i)).cast("double"))


def mutated(a: Column, key: Column, rate: float, step: float) -> Column:
    at = F.sequence(F.lit(0), F.size(a) - 1)

    def one(i: Column) -> Column:
        h = F.crc32(F.concat_ws(":", key.cast("string"), i.cast("string")).cast("binary"))
        return F.when(F.pmod(h, F.lit(1000)) < int(rate * 1000), F.get(a, i).cast("double") + (F.pmod(h, F.lit(2001)) - 1000) / 1000.0 * step).otherwise(F.get(a, i).cast("double"))

    return F.transform(at, one)


def soup(vectors: Column) -> Column:
    """Mean of an array of vectors of one length."""
    n = F.size(vectors)
    return F.transform(F.sequence(F.lit(0), F.size(F.get(vectors, F.lit(0))) - 1), lambda i: _sum(F.transform(vectors, lambda v: F.get(v, i).cast("double"))) / n)


def clipped(a: Column, most: float) -> Column:
    n = norm(a)
    return F.when(n > most, scaled(a, F.lit(most) / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def low_rank(matrix_a: Column, matrix_b: Column, x: Column, scaling: float) -> Column:
    """scaling * B (A x): matrices are arrays of rows."""
    inner = F.transform(matrix_a, lambda row: dot(row, x))
    return F.transform(matrix_b, lambda row: dot(row, inner) * scaling)


def penalty(weights: Column, anchor: Column, importance: Column, strength: float) -> Column:
    """strength / 2 * sum importance * (weights - anchor)^2."""
    moved = F.zip_with(weights, anchor, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return _sum(F.zip_with(importance, moved, lambda f, d: f.cast("double") * d)) * (strength / 2)
