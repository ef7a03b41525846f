"""Target-distribution importance resampling by an external sort-count.

Features of a text are its runs of 1 to ``n`` words, repeats counted; a feature's bucket is the crc32 of its UTF-8
bytes modulo ``buckets``. A bucket's gain is the floored 1000-fold logarithm of its smoothed frequency in the target
over that in the documents; a document's weight is the sum of its features' gains, and its score the weight plus a
Gumbel value drawn from its id. The ``share`` of the eligible documents with the highest scores is drawn.

1. Every text is read once and its buckets are written to the shared folder as packed uint16 streams, one row a block
   of some 32,768 features, with the documents' end offsets beside them: 2 bytes a feature.
2. Counts: each block's stream is sorted and run-length encoded; a task adds up its runs, at most one number a bucket,
   and Spark adds up the tasks. The driver gets two numbers a bucket, however large the corpus is.
3. Weights: gains are gathered along each stream and added up between the offsets by ``np.add.reduceat``.
4. Ranks: only documents at or above the cut are ordered. Counts by score give each score's first rank and the cut;
   rows are numbered within their score, which holds a two-thousandth of the rows at most since the Gumbel values
   spread even copies.

A task holds a block and one text; a long text's words are hashed in runs of 65,536. Texts are never shuffled.

Words: A-Z lower-cased, runs of characters other than ASCII ones that are no letters or digits.

Rows: null and empty texts have no features and weigh 0; ids may be of any type that an array holds and have any name,
a null id draws as the empty text and comes after all others in ties; repeated rows each keep their place; rows of one
id and score are ordered by number of features; other columns are ignored. Without target every t is 0; without documents there are no rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import saved, slices

#: Features in a block, beyond which it is written; words hashed at a time.
BLOCK, RUN = 1 << 15, 1 << 16
#: ASCII bytes other than digits and letters part words, A-Z become a-z.
FOLD = bytes(b if b > 127 or chr(b) in string.ascii_letters + string.digits else 32 for b in range(256)).lower()


def feature_buckets(text: bytes, n: int, buckets: int) -> tuple[int, list[np.ndarray]]:
    """The number of words, and the buckets of all runs of 1 to n words. The crc32 of a run goes on from that of the
    run without its last word."""
    words = text.translate(FOLD).split()
    parts = []
    for at in range(0, len(words), RUN):
        codes = list(map(crc32, words[at:at + RUN]))
        parts.append(np.array(codes, np.uint32))
        spaced = [b" " + w for w in words[at + 1:at + RUN + n - 1]]
        for k in range(n - 1):
            codes = list(map(crc32, spaced[k:k + len(codes)], codes))
            parts.append(np.array(codes, np.uint32))
    return len(words), [(p % buckets).astype(np.uint16) for p in parts]


def streams(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """texts: ``id, text``. Blocks of ``ids, n_words, ends, stream``: packed buckets of several documents and, for each
    of them, where its own end."""
    id_type = texts.schema["id"].dataType
    schema = StructType([StructField("ids", ArrayType(id_type)), *StructType.fromDDL("n_words array<bigint>, ends array<bigint>, stream binary")])
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, ends, parts, total = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            stream = np.concatenate(parts).tobytes() if parts else b""
            listed = pa.concat_arrays(ids)
            one = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
            return pa.RecordBatch.from_arrays([one.cast(arrow.field(0).type), pa.array([sizes], arrow.field(1).type), pa.array([ends], arrow.field(2).type), pa.array([stream], arrow.field(3).type)], schema=arrow)

        for batch in slices(batches, 64):
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                size, found = feature_buckets(text or b"", n, buckets)
                total += sum(map(len, found))
                ids.append(batch.column("id").slice(i, 1))
                sizes.append(size)
                ends.append(total)
                parts += found
                if total >= BLOCK or len(ids) >= BLOCK // 8:
                    yield block()
                    ids, sizes, ends, parts, total = [], [], [], [], 0
        if ids:
            yield block()

    return texts.mapInArrow(pack, schema)


def bucket_counts(blocks: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences by bucket over all blocks."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches, 16):
            for stream in batch.column("stream").to_pylist():
                run = np.sort(np.frombuffer(stream, np.uint16))
                starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
                counts[run[starts]] += np.diff(np.r_[starts, len(run)])
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    for r in blocks.select("stream").mapInArrow(encode, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    t_all, s_all, k = float(target.sum()), float(source.sum()), len(source)
    ratio = lambda t, s: (t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))
    return np.array([math.floor(1000 * math.log(ratio(float(t), float(s)))) for t, s in zip(target, source, strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id, n_words, n_features, weight`` of each document in the blocks."""
    schema = StructType([StructField("id", blocks.schema["ids"].dataType.elementType), *StructType.fromDDL("n_words bigint, n_features bigint, weight bigint")])
    arrow = to_arrow_schema(schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ends = np.array(batch.column("ends")[0].as_py(), np.int64)
            starts = np.r_[0, ends[:-1]]
            out = np.zeros(len(ends), np.int64)
            full = ends > starts  # reduceat gives a single element, not 0, for an empty run
            if full.any():
                out[full] = np.add.reduceat(gain[np.frombuffer(batch.column("stream")[0].as_py(), np.uint16)], starts[full])
            yield pa.RecordBatch.from_arrays([batch.column("ids").flatten().cast(arrow.field(0).type), batch.column("n_words").flatten(), pa.array(ends - starts), pa.array(out)], schema=arrow)

    return blocks.mapInArrow(gather, schema)


def with_ranks(scored: DataFrame, eligible, wanted: int) -> DataFrame:
    """Rank 1, 2, 3... of the ``wanted`` eligible rows of highest score, null for the others."""
    none = F.lit(None).cast("long")
    if wanted < 1:
        return scored.withColumn("rank", none)
    counts = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("score") / 4096))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"))
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", above(W.orderBy(F.desc("part"))).alias("higher"))
    firsts = (counts.withColumn("within", above(W.partitionBy("part").orderBy(F.desc("score")))).join(parts, "part")
              .select("score", (F.col("higher") + F.col("within")).alias("before")).where(F.col("before") < wanted))
    firsts = saved(firsts, "score-ranks")
    cut = firsts.agg(F.min("score")).first()[0]
    drawn = eligible & (F.col("score") >= cut)
    within = F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features"))
    top = scored.where(drawn).withColumn("within", within).join(firsts, "score").withColumn("rank", F.col("before") + F.col("within"))
    top = top.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return top.unionByName(scored.where(~drawn).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, n: int = 3, buckets: int = 10000, seed: str = "42",
             id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_features, weight, score, rank`` of every row: the rank is null for rows not drawn."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets must fit in 16 bits")
    blocks = saved(streams(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, buckets), "bucket-streams")
    wanted = streams(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), n, buckets)
    weighed = weights(blocks, gains(bucket_counts(wanted, buckets), bucket_counts(blocks, buckets)))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = saved(weighed.withColumn("score", F.col("weight") + gumbel), "resampling-scores")
    eligible = F.col("n_words") >= min_words
    ranked = with_ranks(scored, eligible, scored.where(eligible).count() * percent // 100)
    return ranked.withColumnRenamed("id", id_col)
