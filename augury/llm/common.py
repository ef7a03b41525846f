"""Shared helpers: table reads, the shared folder for cut lineage, Arrow slicing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset a temporary folder stands in on
    one machine (tests); on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="augury-"))
    return _OWN[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/augury/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked_by_sort(df: DataFrame, key: list[str], order: list[Column], out: str, tag: str, size: str | None = None) -> DataFrame:
    """df with ``out``, gapless ranks from 0 within each key (null is a key too), and ``size``, the key's rows, if asked for. Rows are sorted over ranges of key and
    order and numbered in their range; the counts of the ranges before shift the numbers, so a key with most rows is as many
    tasks' work as it fills ranges. Only rows that agree in key and order have to share a range."""
    by = [*map(F.col, key), *order]
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = saved(sorted_.withColumn("_number", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), tag)
    counts = ranged.groupBy(*key, "_range").agg(F.count("*").alias("_n"), F.min("_number").alias("_first"))
    of = W.partitionBy(*key)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_range").alias("_at"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of).alias("_all"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)] + [F.col("_range") == F.col("_at")]
    more = [F.col("_all").alias(size)] if size else []
    return ranged.join(shifts, same).select(*df.columns, (F.col("_number") + F.col("_shift")).alias(out), *more)


def give_back() -> None:
    """Return freed memory to the system. Else what a fit took stays with the driver for all that follows."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small slices, so that Python objects for a slice stay few."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def crc32_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n: the fold of a row."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train_where, *, id_col: str = "doc_id",
                    text_col: str = "text", per_class: int = 1500, max_bytes: int = 48 << 20) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts on the driver: of each class the ``per_class`` rows whose id
    hashes lowest, and of those as many as fit in ``max_bytes``. Rows without a label, an id or a text of
    their own class don't count; several labels of one id: the largest holds."""
    folds = (labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & train_where)
             .groupBy(id_col).agg(F.max(label).alias("_label")).withColumn("_h", F.xxhash64(F.col(id_col), F.lit(7))))
    rows: list[tuple[str, int]] = []
    for value in (0, 1):
        ids = folds.where(F.col("_label") == value).orderBy("_h", id_col).limit(per_class).select(id_col, "_h")
        picked = (docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
                  .join(F.broadcast(ids), id_col).select("_h", "_text", F.octet_length("_text").alias("_n")))
        total = 0
        for r in picked.orderBy("_h", "_text").toLocalIterator():
            if total + r["_n"] <= max_bytes:
                rows.append((r["_text"], value))
                total += r["_n"]
    return rows
