"""Text-quality rules: each a named reason, the first that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from augury.functions.dates import col


def garbage_reasons(c: Column | str) -> Column:
    """short, repetitive, symbols, whitespace, shouting or ok."""
    x = col(c)
    tokens = F.split(F.lower(F.trim(x)), r"\s+")
    symbols = F.length(F.regexp_replace(x, "[^!*%$&#|]", ""))
    return (F.when(F.length(F.trim(x)) < 40, "short")
            .when(F.size(F.array_distinct(tokens)) < 0.3 * F.size(tokens), "repetitive")
            .when(symbols > 0.05 * F.length(x), "symbols")
            .when(x.rlike(r"\s{6,}"), "whitespace")
            .when(x == F.upper(x), "shouting").otherwise("ok"))
