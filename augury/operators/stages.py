"""Finished tables of long jobs, found again by what went into them.

A manifest in the shared folder has one row for each finished table: its stage, a key over the stage's parameters and
the digest of its inputs, and where the table is. A job that starts again after a crash finds the stages that ended and
goes on at the first that didn't: a table counts only once its row is written, which is after the table is. Changed inputs
or parameters are another key. ``retire`` empties the tables of a stage's older keys.

The manifest is read and written by Spark as small JSON files, so it can be in any store that the cluster writes to;
one row a stage and key, whatever the size of the data.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions.lineage import shared_folder

ROW = "stage string, key string, path string, finished timestamp"


def files_digest(df: DataFrame) -> str:
    """Digest of the files a table is read from: names, sizes and times of change, whatever their order."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n}:{total}"


class Manifest:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or f"{shared_folder(spark)}/augury-stages").rstrip("/")

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(ROW).json(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ROW)

    @staticmethod
    def key(stage: str, inputs: str, params: dict) -> str:
        return hashlib.sha256(json.dumps([stage, inputs, params], sort_keys=True, default=str).encode()).hexdigest()[:32]

    def find(self, stage: str, key: str) -> str | None:
        """Where a finished table is."""
        found = self.rows().where((F.col("stage") == stage) & (F.col("key") == key)).orderBy(F.desc("finished"), "path").first()
        return found["path"] if found else None

    def finish(self, stage: str, key: str, path: str) -> None:
        row = self.spark.createDataFrame([(stage, key, path)], "stage string, key string, path string").withColumn("finished", F.current_timestamp())
        row.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def place(self, stage: str) -> str:
        return f"{self.folder}/tables/{stage}-{uuid.uuid4().hex}"

    def table(self, stage: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The finished table of a key, made now if there is none."""
        if (path := self.find(stage, key)) is None:
            path = self.place(stage)
            make().write.option("compression", "zstd").parquet(path)
            self.finish(stage, key, path)
        return self.spark.read.parquet(path)

    def retire(self, stage: str, keep: str) -> int:
        """Empty a stage's tables of other keys; how many."""
        old = [r["path"] for r in self.rows().where((F.col("stage") == stage) & (F.col("key") != keep)).select("path").distinct().toLocalIterator()]
        for path in old:
            self.spark.createDataFrame([], "retired int").write.mode("overwrite").parquet(path)
        if old:
            kept = self.rows().where((F.col("stage") != stage) | (F.col("key") == keep)).collect()  # one row a stage and key
            self.spark.createDataFrame(kept, ROW).coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest")
        return len(old)


def run_stages(manifest: Manifest, name: str, inputs: str, given: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], params: dict, *, retire: bool = False) -> DataFrame:
    """A chain of stages, each over the table of the one before, resuming at the first that hasn't finished. retire: once all have, the
    stages' tables of other inputs and parameters are emptied."""
    key, keys = inputs, {}
    for stage, f in stages:
        at = f"{name}-{stage}"
        key = keys[at] = Manifest.key(at, key, params.get(stage, {}))
        given = manifest.table(at, key, lambda f=f, given=given: f(given))
    for at, kept in keys.items() if retire else ():
        manifest.retire(at, kept)
    return given
