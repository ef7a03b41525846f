"""Monitoring operators that work alike on batch and streaming frames, and the ordered ones that need a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def buckets(df: DataFrame, ts: str, every: str, keys: Sequence[str], aggs: Sequence[Column], slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows: ``start``, keys and aggregates. Streams need a watermark on ts before."""
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    out = df.groupBy(w.alias("_w"), *keys).agg(*aggs)
    return out.select(F.col("_w.start").alias("start"), *(c for c in out.columns if c != "_w"))


def sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    out = df.groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(*aggs)
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *(c for c in out.columns if c != "_w"))


def pair_start_end(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_start: Column, is_end: Column, at: str) -> DataFrame:
    """Intervals: each start with the next end of its key; open (null) if another start or nothing follows."""
    w = W.partitionBy(*keys).orderBy(*order)
    marks = df.where(is_start | is_end).withColumn("_start", is_start)
    nxt = marks.withColumns({"_at": F.lead(at).over(w), "_open": F.lead("_start").over(w)})
    return nxt.where("_start").select(*keys, F.col(at).alias("started"), F.when(~F.col("_open"), F.col("_at")).alias("ended"))


def held_for(df: DataFrame, keys: Sequence[str], order: Sequence[str], cond: Column, n: int, out: str = "held") -> DataFrame:
    """df with a flag: the condition holds at this row and at the n - 1 before it."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, (F.min(cond.cast("int")).over(w) == 1) & (F.count("*").over(w) == n))


def alert_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], firing: Column, at: str) -> DataFrame:
    """Alert lifetimes: ``opened, resolved`` of each run of firing rows; resolved is the first quiet row, null while open."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_f", firing)
    edge = rows.withColumn("_edge", (F.col("_f") != F.coalesce(F.lag("_f").over(w), F.lit(False)))).where("_edge")
    nxt = edge.withColumn("_to", F.lead(at).over(w))
    return nxt.where("_f").select(*keys, F.col(at).alias("opened"), F.col("_to").alias("resolved"))


def first_within(df: DataFrame, keys: Sequence[str], ts: str, tie: str, ttl: str) -> DataFrame:
    """Rows whose key was not seen in the ttl before them (by the row just before): duplicates inside it go."""
    w = W.partitionBy(*keys).orderBy(ts, tie)
    prev = F.lag(ts).over(w)
    return df.withColumn("_p", prev).where(F.col("_p").isNull() | (F.col(ts) > F.col("_p") + F.expr(f"INTERVAL {ttl}"))).drop("_p")


def narrowest_window(df: DataFrame, keys: Sequence[str], age: Column, windows: Sequence[int], least: int, value: Column) -> DataFrame:
    """``keys, days, n, total, enough``: for each key the narrowest of the nested windows that holds ``least`` rows, the widest one if none does, with what it
    holds. All windows are counted in one pass over rings, the ages between one window and the one before; a key moves a row a ring."""
    ring = F.lit(None).cast("int")
    for w in sorted(windows, reverse=True):
        ring = F.when(age < w, w).otherwise(ring)
    rings = df.where(age >= 0).select(*keys, ring.alias("days"), value.alias("v")).where("days IS NOT NULL").groupBy(*keys, "days").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    # a ring without rows would be a window's end too
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, sorted(windows)))).alias("days"))
    up = W.partitionBy(*keys).orderBy("days")
    full = grid.join(rings, [*keys, "days"], "left").select(*keys, "days", F.sum(F.coalesce("n", F.lit(0))).over(up).alias("n"), F.sum("v").over(up).alias("total"))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.col("n") >= least), F.when(F.col("n") >= least, F.col("days")).otherwise(-F.col("days"))))
    return full.withColumn("_r", first).where("_r = 1").select(*keys, "days", "n", "total", (F.col("n") >= least).alias("enough"))
