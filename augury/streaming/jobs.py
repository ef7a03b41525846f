"""Continuous versions: file streams in, watermarked state, exactly-once sinks out.

State is bounded by watermarks or timeouts, and sinks are keyed by batch id, so a restarted query neither loses
nor repeats rows. Sources and checkpoints have to lie in shared storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from augury.operators import monitoring as M


def events(spark: SparkSession, path: str, schema: StructType, files: int = 1, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream over the Parquet files of a folder, ``files`` a batch, rows later than ``late`` dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(stream: DataFrame, every: str, keys: Sequence[str], aggs: Sequence[Column], ts: str = "ts") -> DataFrame:
    return M.buckets(stream, ts, every, keys, aggs)


def sessions(stream: DataFrame, gap: str, keys: Sequence[str], aggs: Sequence[Column], ts: str = "ts") -> DataFrame:
    return M.sessions(stream, ts, gap, keys, aggs)


def deduplicated(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each key inside the watermark; state older than it is dropped."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def paired(stream: DataFrame, key: str, start: str, end: str, timeout_ms: int) -> DataFrame:
    """``key, started, ended``: starts paired with the next end of their key; a start that waits longer than the
    timeout (in event time) comes out open. State: one start a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        waiting = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "started": [pd.Timestamp(waiting)], "ended": [pd.NaT]})
            return
        for part in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: (r.ts, r.event_id)):
            if part.event_type == start:
                if waiting is not None:
                    rows.append((k[0], pd.Timestamp(waiting), pd.NaT))
                waiting = str(part.ts)
            elif waiting is not None:
                rows.append((k[0], pd.Timestamp(waiting), part.ts))
                waiting = None
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update((waiting,))
            state.setTimeoutTimestamp(max(int(pd.Timestamp(waiting).timestamp() * 1000), state.getCurrentWatermarkMs()) + timeout_ms)
        yield pd.DataFrame(rows, columns=["key", "started", "ended"]).astype({"started": "datetime64[ns]", "ended": "datetime64[ns]"})

    kept = stream.where(F.col("event_type").isin(start, end)).select(key, "ts", "event_id", "event_type")
    return kept.groupBy(key).applyInPandasWithState(step, "key long, started timestamp, ended timestamp", "waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def leased(stream: DataFrame, item: str, worker: str, done: Column, lease_s: int) -> DataFrame:
    """``item, worker, ts`` of granted claims, as they come: exactly one winner of an item while a lease holds. State: an item's last grant, or that
    it is done. Claims of a batch go by time and then by worker; one that is older than what its item's state has seen is refused, never regranted."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (None, False)
        won = []
        for r in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: (r.ts, not r.done, r.worker)):
            if ended:
                break
            at = int(r.ts.value // 1000)
            if r.done:
                ended = True
            elif last is None or at - last >= lease_s * 1_000_000:
                won.append((k[0], r.worker, r.ts))
                last = at
        state.update((last, ended))
        yield pd.DataFrame(won, columns=["item", "worker", "ts"]).astype({"ts": "datetime64[ns]"})

    asked = stream.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.coalesce(F.col(worker).cast("string"), F.lit("")).alias("worker"), "ts", F.coalesce(done, F.lit(False)).alias("done"))
    kind = asked.schema["item"].dataType.simpleString()
    return asked.groupBy("item").applyInPandasWithState(step, f"item {kind}, worker string, ts timestamp", "last long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def sink_once(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "append") -> StreamingQuery:
    """Each batch into its own folder, overwritten if the batch runs again."""

    def write(df: DataFrame, batch: int) -> None:
        change(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
