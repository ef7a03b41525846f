"""Vector expressions on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import col


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(v: Column | str) -> Column:
    """The vector and its length are worked out once, not again for every component."""
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    return once(doubles(v), lambda w: once(norm(w), lambda n: F.transform(w, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def prefix(v: Column | str, dims: int) -> Column:
    """A leading part of a nested embedding, normalised anew."""
    return unit(F.slice(col(v), 1, dims))
