"""Arithmetic on array columns, summed from left to right in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row: inside a lambda it
    would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector becomes nulls, which no distance counts."""
    return let(F.nullif(norm(v), F.lit(0.0)), lambda n: F.transform(v, lambda x: x / n))


def prefix(v: Column, n: int) -> Column:
    return F.slice(v, 1, n)


def suffix(v: Column, n: int) -> Column:
    """The last ``n`` values, all of them if there are fewer."""
    return F.slice(v, F.greatest(F.size(v) - n + 1, F.lit(1)), F.lit(n))


def stride(v: Column, n: int) -> Column:
    """Every n-th value from the first on."""
    return F.filter(v, lambda x, i: i % n == 0)


def mean(v: Column) -> Column:
    return total(v) / F.nullif(F.size(v), F.lit(0))


def softmax(v: Column) -> Column:
    powers = F.transform(v, lambda x: F.exp(x))
    return let(powers, lambda p: let(total(p), lambda whole: F.transform(p, lambda x: x / whole)))


def masked_mean(vectors: Column, mask: Column, width: int) -> Column:
    """Mean over the vectors whose mask is 1; without any, zeros (divided by 1)."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda p: p["m"] == 1), lambda p: p["v"])
    places = F.sequence(F.lit(0), F.lit(width - 1))
    return let(kept, lambda k: F.transform(places, lambda i: F.aggregate(k, F.lit(0.0), lambda a, v: a + F.get(v, i)) / F.greatest(F.size(k), F.lit(1))))


def multi_hot(labels: Column, universe: Column) -> Column:
    """1 for each label of the universe that is among the labels, else 0."""
    return F.transform(universe, lambda u: F.array_contains(labels, u).cast("int"))
