"""A work queue as an append-only log of claims: who asked for which item when, and who finished it. Nothing is locked or updated; who holds an item
follows from the log alone, so every reader comes to the same answer, and a reader that starts again does too.

A claim is granted if nobody holds the item: nobody ever did, or the last grant is older than the lease. Claims of the same moment go by the
worker's name. From the moment an item is done no claim is granted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grants(log: DataFrame, item: str, worker: str, at: str, done: Column, lease_s: int) -> DataFrame:
    """``item, worker, at`` of every granted claim. Rows of log where done holds finish their item. An item's claims are one array,
    in order: a fold keeps the last grant."""
    told = log.where(F.col(item).isNotNull() & F.col(at).isNotNull())
    claim = F.struct(F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.coalesce(F.col(worker).cast("string"), F.lit("")).alias("w"))
    per = told.groupBy(item).agg(F.array_sort(F.collect_list(F.when(~done, claim))).alias("claims"), F.min(F.when(done, F.unix_micros(F.col(at).cast("timestamp")))).alias("end"))
    kind = "array<struct<t:bigint,w:string>>"
    free = lambda got, c: F.coalesce(c["t"] - F.element_at(got, -1)["t"] >= lease_s * 1_000_000, F.lit(True))
    open_ = lambda c: F.coalesce(c["t"] < F.col("end"), F.lit(True))
    fold = F.aggregate("claims", F.array().cast(kind), lambda got, c: F.when(open_(c) & (F.size(got) == 0), F.array(c)).when(open_(c) & free(got, c), F.concat(got, F.array(c))).otherwise(got))
    return per.select(item, F.explode(fold).alias("g")).select(item, F.col("g.w").alias(worker), F.timestamp_micros("g.t").alias(at))
