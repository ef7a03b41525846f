"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="augury-cut-"))
        base = _OWN[0]
    return base.rstrip("/")


def cut(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write to the shared folder, in folders by the values of the columns in ``by``, and read back: the lineage ends there and survives lost
    executors."""
    path = f"{shared_folder(df.sparkSession)}/augury-cut/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
