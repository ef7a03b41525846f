"""Sinks: versioned snapshots, append-only logs, atomic publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(df: DataFrame, path: str, run_id: str) -> None:
    """One run in its own partition; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest run."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max("run_id").alias("run_id"))), "run_id")  # one row


def append_json(df: DataFrame, path: str, kind: str) -> None:
    """Rows as JSON payloads in an append-only log."""
    df.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("payload")).write.mode("append").parquet(path)


def publish(df: DataFrame, name: str, path: str) -> DataFrame:
    """A full rebuild at a new place, then the view moves to it: readers see the old or the new, never a mix."""
    df.write.mode("errorifexists").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.createOrReplaceTempView(name)
    return out


def append_new(df: DataFrame, path: str, key: str, exists: bool) -> int:
    """Rows of df whose key the table at path lacks, appended; how many they were."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    if exists:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new = new.persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n
