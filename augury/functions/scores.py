"""Score expressions: guarded ratios, rates, scalings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import col


def ratio(a: Column | str, b: Column | str) -> Column:
    """null, not an error or 0, where there is nothing to divide by."""
    return F.when(col(b) != 0, col(a) / col(b))


def per_10k(n: Column | str, total: Column | str, floor: int = 30) -> Column:
    """Withheld below the floor."""
    return F.when(col(total) >= floor, F.round(10000.0 * col(n) / col(total), 1))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def log_scale(x: Column | str, top: float) -> Column:
    """0..1: log of 1 + x over log of 1 + top."""
    return clamp(F.log1p(col(x).cast("double")) / F.log1p(F.lit(top)), 0.0, 1.0)


def quantise16(x: Column | str, reach: float) -> Column:
    """-reach..reach to 0..65535."""
    return F.round((clamp(col(x).cast("double"), -reach, reach) + reach) / (2 * reach) * 65535).cast("int")


def nearly_equal(a: Column | str, b: Column | str, rel: float = 1e-6) -> Column:
    return F.abs(col(a) - col(b)) <= rel * F.greatest(F.lit(1.0), F.abs(col(a)), F.abs(col(b)))


def knuth_bucket(i: Column | str, buckets: int) -> Column:
    """Multiplicative hash modulo 2**32, reduced first so that the product fits a long."""
    return F.pmod(F.pmod(F.pmod(col(i).cast("long"), F.lit(4294967296)) * F.lit(2654435761 % 65536) + F.pmod(F.pmod(col(i).cast("long"), F.lit(65536)) * F.lit(2654435761 // 65536), F.lit(65536)) * 65536, F.lit(4294967296)), F.lit(buckets))
