"""Series operators over long-format counts (key, period, n). Periods are whole numbers (integer months, years,
weeks), so frames are ranges of periods and gaps stay gaps. Thin or incomplete data gives null, never 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def zero_filled(counts: DataFrame, keys: Sequence[str], period: str, n: str, step: int = 1) -> DataFrame:
    """Every period between each key's first and last, 0 where it has no row."""
    span = counts.groupBy(*keys).agg(F.min(period).alias("_a"), F.max(period).alias("_b"))
    every = span.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step))).alias(period))
    return every.join(counts, [*keys, period], "left").select(*keys, period, F.coalesce(n, F.lit(0)).cast("long").alias(n))


def trailing(keys: Sequence[str], period: str, back: int, until: int = 0):
    """The window of periods from ``back`` before to ``until`` before the row's."""
    return W.partitionBy(*keys).orderBy(period).rangeBetween(-back, -until)


def onset(counts: DataFrame, keys: Sequence[str], period: str, n: str, frac: float = 0.1, least: int = 3) -> DataFrame:
    """First period at which the running total reaches max(least, frac of all)."""
    w = W.partitionBy(*keys)
    run = counts.withColumn("_run", F.sum(n).over(w.orderBy(period))).withColumn("_all", F.sum(n).over(w))
    return run.groupBy(*keys).agg(F.min(F.when(F.col("_run") >= F.greatest(F.lit(float(least)), F.col("_all") * frac), F.col(period))).alias("onset"))


def takeoff(shares: DataFrame, keys: Sequence[str], period: str, share: str, at: float = 0.5, base: float = 0.2, points: int = 4) -> DataFrame:
    """First period whose share reaches ``at`` of the key's peak; genuine if the first share lies strictly under
    ``base`` of it; null with fewer than ``points`` points."""
    w = W.partitionBy(*keys)
    p = shares.withColumn("_peak", F.max(share).over(w)).withColumn("_k", F.count("*").over(w))
    first = F.min_by(share, period)
    out = p.groupBy(*keys).agg(F.min(F.when(F.col(share) >= at * F.col("_peak"), F.col(period))).alias("_t"), (first < base * F.max("_peak")).alias("_g"), F.max("_k").alias("_n"))
    return out.select(*keys, F.when(F.col("_n") >= points, F.col("_t")).alias("takeoff"), F.when(F.col("_n") >= points, F.col("_g")).alias("genuine"))


def carried_forward(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Nulls filled with the last value known."""
    return df.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(period).rowsBetween(W.unboundedPreceding, W.currentRow)))


def placed_by_value(df: DataFrame, key: Sequence[str], value: str, ties: Sequence[str], width: float) -> DataFrame:
    """df with ``_row`` (rows of the key before it by value and ties), ``_rank`` (rows of smaller value) and ``_n`` (rows of the key). Rows are numbered within bands of ``width`` of
    their value and shifted by the counts of the bands below, so that no key has to fit in one task; null values are below all others."""
    band = F.coalesce(F.floor(F.col(value) / width), F.lit(-(1 << 62))).cast("long")
    parted = df.withColumn("_band", band)
    counts = parted.groupBy(*key, "_band").agg(F.count("*").alias("_c"))
    of = W.partitionBy(*key)
    below = F.coalesce(F.sum("_c").over(of.orderBy("_band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_band").alias("_at"), below.alias("_below"), F.sum("_c").over(of).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)] + [F.col("_band") == F.col("_at")]
    inside = W.partitionBy(*key, "_band")
    told = parted.withColumns({"_in": F.row_number().over(inside.orderBy(value, *ties)) - 1, "_tied": F.rank().over(inside.orderBy(value)) - 1}).join(shifts, same)
    return told.select(*df.columns, (F.col("_below") + F.col("_in")).alias("_row"), (F.col("_below") + F.col("_tied")).alias("_rank"), "_n")


def percent_ranks(df: DataFrame, key: Sequence[str], value: str, width: float, out: str) -> DataFrame:
    """percent_rank within each key: the share of the others that are smaller, 0 for a key of one row."""
    placed = placed_by_value(df, key, value, [], width)
    return placed.withColumn(out, F.when(F.col("_n") > 1, F.col("_rank") / (F.col("_n") - 1)).otherwise(0.0)).drop("_row", "_rank", "_n")


def cohort_percentile(df: DataFrame, value: str, tie: str, cohort: Sequence[str], wider: Sequence[str], least: int, out: str, width: float) -> DataFrame:
    """Mid-rank percentile within the cohort, within the wider one where the cohort is smaller than ``least``."""
    own = placed_by_value(df, cohort, value, [tie], width).withColumnsRenamed({"_row": "_own_row", "_n": "_own_n"}).drop("_rank")
    both = placed_by_value(own, wider, value, [tie], width)
    mid = lambda row, n: (F.col(row) + 0.5) / F.col(n)
    return both.withColumn(out, F.when(F.col("_own_n") >= least, mid("_own_row", "_own_n")).otherwise(mid("_row", "_n"))).drop("_own_row", "_own_n", "_row", "_rank", "_n")


def rank_in_parts(df: DataFrame, key: list[str], hashed: str, ties: list[str], out: str, digits: int = 2) -> DataFrame:
    """Ranks from 0 within a key by a column of hex hashes: within the parts that their first digits make, shifted by
    the counts of the parts before, so that no key has to fit in one task."""
    parted = df.withColumn("_part", F.substring(hashed, 1, digits))
    counts = parted.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shifts = counts.select(*key, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(*key, "_part").orderBy(hashed, *ties)) - 1
    return parted.withColumn("_within", within).join(shifts, [*key, "_part"]).withColumn(out, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")
