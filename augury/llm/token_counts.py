"""Token counts through a digest cache.

A text's digest (sha-256 of its UTF-8 bytes, null as empty) with the digest of the tokenizer file is the key
of a Parquet table of counts. Texts whose key is stored are not encoded again; of the others each distinct
one is encoded once, and its count is appended.

Scale: ids and digests are what the joins move; a digest that very many rows share (null, empty, copied texts) is joined by
broadcast, and there can't be many such. Missing texts move once, zstd-packed, after each task has
dropped its own repeats, so a group of copies sends one row per task at most. Inside a task each distinct
chunk of text is encoded once: the byte-level pattern always starts a new pre-token at a space behind a
non-space character, so counts of such chunks add up to the count of the text.

Rows: null text is empty and has no tokens; repeated rows and ids keep their rows; an empty table gives an
empty result and leaves the cache as it was.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices

#: Digests with a HOT-th of all rows are joined apart; there are HOT of them at most.
HOT = 256
#: Chunks kept by one Python worker; beyond it starts anew (memory, not results).
CHUNK_ENTRIES = 200_000
_SPACES = re.compile(r"\s\s")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


class ChunkCounter:
    """Counts tokens of texts; each distinct chunk goes through the tokenizer once."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread and one memory arena in a worker
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = self.tokenizer.pre_tokenizer
        self.separable = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.tokenizer.normalizer is None
        # A special token's string could lie across chunks if it held a space, and is no ordinary text.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.counts: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        parts = (texts[i:i + 2048] for i in range(0, len(texts), 2048))
        return [len(e.ids) for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def chunks(self, text: str) -> list[str]:
        if not self.separable or any(s in text for s in self.special):
            return [text]
        if _SPACES.search(text) is None and text[:1] != " ":
            first, *rest = text.split(" ")
            return [first, *(" " + w for w in rest)]
        return _BEFORE_SPACE.split(text)

    def __call__(self, texts: list[str]) -> list[int]:
        parts = [self.chunks(t) if t else [] for t in texts]
        keys = set().union(*parts)
        if len(self.counts) + len(keys) > CHUNK_ENTRIES:
            self.counts.clear()
        new = [k for k in keys if k not in self.counts]
        self.counts.update(zip(new, self._encode(new), strict=True))
        return [sum(map(self.counts.__getitem__, p)) for p in parts]


def tokenizer_digest(tokenizer_file: str) -> str:
    with open(tokenizer_file, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The stored counts of one tokenizer version; None where nothing is stored yet."""
    try:
        return spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer, seen = zstandard.ZstdCompressor(level=1), set()
    for part in slices(batches):
        digests, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
        new = [(d, packer.compress(t.encode())) for d, t in zip(digests, texts, strict=True) if d not in seen and not seen.add(d)]
        if new:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*new, strict=True)], names=["digest", "packed"])


def count_tokens(docs: DataFrame, tokenizer_file: str, cache: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` of every row of docs; new counts are appended to ``cache``."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_file)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    keyed = saved(docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), digest), "token-digests")
    missing, known = docs.select(digest, text.alias("_text")), read_cache(spark, cache, version)
    if known is not None:
        missing = missing.join(known.select("digest").distinct(), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        count, unpack, seen = ChunkCounter(tokenizer_file), zstandard.ZstdDecompressor(), set()
        for part in slices(batches, 32):
            rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            new = [(d, unpack.decompress(p).decode()) for d, p in rows if d not in seen and not seen.add(d)]
            if new:
                found = [pa.array([d for d, _ in new], pa.binary()), pa.array(count([t for _, t in new]), pa.int64())]
                yield pa.RecordBatch.from_arrays(found, names=["digest", "n_tokens"])

    (missing.mapInArrow(_pack, "digest binary, packed binary").repartition("digest")
     .mapInArrow(encode, "digest binary, n_tokens long").write.mode("append").parquet(f"{cache}/version={version}"))
    counts = read_cache(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # texts that make a HOT-th of all rows or more, at most HOT of them, go to all executors, so no task gets their rows
    hot = keyed.groupBy("digest").agg(F.count("*").alias("_n")).where(F.col("_n") * HOT >= keyed.count()).select("digest")
    common = F.broadcast(counts.join(F.broadcast(hot), "digest").withColumnRenamed("n_tokens", "_common"))
    marked = keyed.join(common, "digest", "left")
    rest = marked.where("_common IS NULL").join(counts, "digest").select(id_col, "n_bytes", "n_tokens")
    return marked.where("_common IS NOT NULL").select(id_col, "n_bytes", F.col("_common").alias("n_tokens")).unionByName(rest)
