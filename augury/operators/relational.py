"""Relational operators: caps, latest rows, facets, as-of and interval joins, change plans.

Every ordering ends in a unique key given by the caller, so results are the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.lineage import cut


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key. Spark cuts each task to n rows a key before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def facet_counts(df: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """``facet, value, n``: for each facet, counts under all filters but its own. One pass over df."""
    parts = []
    for name in facets:
        others = reduce(lambda a, b: a & b, [c for k, c in facets.items() if k != name], F.lit(True))
        parts.append(F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value"), others.alias("keep")))
    return df.select(F.explode(F.array(*parts)).alias("x")).where("x.keep").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def pairs_within(df: DataFrame, group: str | Sequence[str], item: str) -> DataFrame:
    """``group, a, b`` with a < b: items that stand in one group, each pair once. A group's items are made
    distinct and held as one array, so the pairs come from one shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    sets = df.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("xs"))
    pairs = F.flatten(F.transform("xs", lambda x, i: F.transform(F.slice("xs", i + 2, F.size("xs")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(*keys, F.inline(pairs))


def asof_latest(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str) -> DataFrame:
    """left with the value of the newest right row of the same key at or before its time. A union and one
    window instead of a range join: linear in both sides."""
    tagged = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    other = right.select(key, ts, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = tagged.unionByName(other, allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True).over(W.partitionBy(key).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn(out, seen).where("_side = 1").drop("_side", "_v")


def tolerance_join(left: DataFrame, right: DataFrame, key: str, day_l: str, day_r: str, days: int) -> DataFrame:
    """Rows of one key at most ``days`` apart (day_l, day_r are day numbers). Each side falls into blocks of that
    many days and left meets its own and both neighbours, so this is an equi-join however large a key is."""
    b = F.floor(F.col(day_r) / days)
    spread = left.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(day_l) / days) + d)))
    return spread.join(right.withColumn("_b", b), [key, "_b"]).where(F.abs(F.col(day_l) - F.col(day_r)) <= days).drop("_b")


def change_plan(held: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, action``: insert, update, retract or unchanged, from a full outer join of two states."""
    h, n = held.select(key, F.col(value).alias("_h"), F.lit(True).alias("_in_h")), new.select(key, F.col(value).alias("_n"), F.lit(True).alias("_in_n"))
    action = F.when(F.col("_in_h").isNull(), "insert").when(F.col("_in_n").isNull(), "retract").when(~F.col("_h").eqNullSafe(F.col("_n")), "update").otherwise("unchanged")
    return h.join(n, key, "full").select(key, action.alias("action"))


def insert_new(held: DataFrame, new: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """held, and of each key it lacks the first of new."""
    return held.unionByName(first_per_key(new, [key], order).join(held.select(key), key, "left_anti"))


def upsert(held: DataFrame, new: DataFrame, key: str, columns: Sequence[str], keep_old: bool = True) -> DataFrame:
    """Merge by key: columns filled from the other side where null; keep_old: the held value wins."""
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_{c}")) if keep_old else F.coalesce(F.col(f"_{c}"), F.col(c))
    return held.join(n, key, "full").select(key, *(pick(c).alias(c) for c in columns))


def clamped_count(df: DataFrame, most: int) -> DataFrame:
    """``n, clamped``: the count, but no more rows are read than it takes to pass ``most``."""
    got = df.limit(most + 1).agg(F.count("*").alias("n"))
    return got.select(F.least("n", F.lit(most)).alias("n"), (F.col("n") > most).alias("clamped"))


def greedy_picks(df: DataFrame, group: str, order: Sequence[Column], items: Sequence[str], clash: Callable[[Column, Column], Column], n: int) -> DataFrame:
    """``group, picked``: of every group up to n rows (structs of items, as taken), the best first, then always the best that clashes with none taken. ``order`` ends in a total order.
    A round for each pick: one aggregation that keeps a row a group, and a join with what is taken, a short array; a group is never gathered. clash(row, taken) is over structs
    of items."""
    rows = df.select(group, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("_o"), F.struct(*items).alias("_x"))
    kind = rows.schema["_x"].dataType.simpleString()
    taken = df.select(group).distinct().withColumn("picked", F.array().cast(f"array<{kind}>"))
    for _ in range(n):
        free = rows.join(taken, group).where(~F.exists("picked", lambda y: clash(F.col("_x"), y)))
        best = free.groupBy(group).agg(F.min_by("_x", "_o").alias("_best"))
        step = taken.join(best, group, "left").select(group, F.when(F.col("_best").isNull(), F.col("picked")).otherwise(F.concat("picked", F.array("_best"))).alias("picked"))
        taken = cut(step, "picks")
    return taken
