"""A positional inverted index: terms to the places where documents hold them, stored as Parquet.

A posting row has all places of one surface word in one block of 4,096 document ids: sorted numbers of document offset
and position. Parquet's delta encoding packs them, so a place takes some bytes, and blocks split frequent words over many
rows and files. Rows lie in folders by the hash of the stem and are sorted by stem and word within a file, so looking
up a few words reads a few row groups. Words are looked up by stem or as they are.

Documents are appended in batches: new ids only; a batch counts once its row is in the table of batches, which is written
last, so a failed append leaves nothing that readers see and can simply run again.

Answers come from postings alone. Terms and phrases are intersected block by block: an array a term and block, joined on
the block, no text is read. Every matching id comes back, whatever their number; a page is a sort and a limit on top.

Rows: ids are whole numbers; null ids and texts, and texts without words, are not indexed; of rows of one id in a batch all words count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions.text import stem
from augury.functions.tokens import worded

BITS, PARTS, SPREAD = 12, 32, 8
POSTING = "stem string, term string, block bigint, n_docs int, places array<bigint>, batch string, part int"


def part_of(stemmed: Column) -> Column:
    return F.pmod(F.xxhash64(stemmed), F.lit(PARTS)).cast("int")


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of ``id, words``: ``term, block, places``, a row for each word and block of a batch, so that words are sent once for many places."""
    for b in batches:
        lists = b.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        said = lists.flatten().dictionary_encode()
        if not len(said):
            continue
        ids = b.column(0).to_numpy(zero_copy_only=False)
        blocks, nth = np.unique(ids >> BITS, return_inverse=True)
        keys = np.repeat(nth * len(said.dictionary), sizes) + said.indices.to_numpy()
        places = np.repeat((ids & ((1 << BITS) - 1)) << 32, sizes) + (np.arange(len(said)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        nth, terms = np.divmod(keys[start], len(said.dictionary))
        held = pa.ListArray.from_arrays(pa.array(np.append(start, len(keys)), pa.int32()), pa.array(places[order], pa.int64()))
        yield pa.RecordBatch.from_arrays([said.dictionary.take(pa.array(terms)), pa.array(blocks[nth], pa.int64()), held], ["term", "block", "places"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of ``part, stem, term, block, places``, sorted by the first four: one row for each word and block, with its number of documents
    and its places in order. The last run of a batch waits for the next one."""
    names = ["part", "stem", "term", "block", "n_docs", "places"]

    def told(b: pa.RecordBatch, start: np.ndarray) -> pa.RecordBatch:
        at = b.column("places").offsets.to_numpy()
        values = b.column("places").flatten().to_numpy().copy()
        begin = at[start] - at[0]
        first = np.zeros(len(values), bool)
        first[begin] = True
        run = np.cumsum(first) - 1
        falls = np.flatnonzero((values[1:] < values[:-1]) & ~first[1:]) + 1
        if len(falls):
            mixed = np.zeros(len(start), bool)
            mixed[run[falls]] = True
            at_mixed = mixed[run]
            values[at_mixed] = values[at_mixed][np.lexsort((values[at_mixed], run[at_mixed]))]
        docs = values >> 32
        other = first.copy()
        other[1:] |= docs[1:] != docs[:-1]
        held = pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)), pa.int32()), pa.array(values, pa.int64()))
        keys = [b.column(n).take(pa.array(start)) for n in names[:4]]
        return pa.RecordBatch.from_arrays([*keys, pa.array(np.add.reduceat(other, begin, dtype=np.int32), pa.int32()), held], names)

    def starts(b: pa.RecordBatch) -> np.ndarray:
        term, block = b.column("term").dictionary_encode().indices.to_numpy(), b.column("block").to_numpy()
        return np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))

    left = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if left is None else pa.concat_batches([left, b])
        start = starts(b)
        left = b.slice(start[-1])
        if len(start) > 1:
            yield told(b.slice(0, start[-1]), start[:-1])
    if left is not None:
        yield told(left, np.zeros(1, np.int64))


def lowered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text``, in lower case; null reads as empty."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``part, stem, term, block, n_docs, places`` of documents, a task's rows being those of some parts and blocks; one shuffle, of places packed by
    word and block, which are then merged as they come sorted."""
    found = lowered(docs, id_col, text_col).mapInArrow(lambda batches: packed(worded(batches)), "term string, block bigint, places array<bigint>")
    spread = found.withColumns({"part": part_of(stem(F.col("term"))), "slot": F.pmod("block", F.lit(SPREAD))}).repartition("part", "slot")
    keys = ["part", "stem", "term", "block"]
    rows = spread.withColumn("stem", stem(F.col("term"))).select(*keys, "places").sortWithinPartitions(*keys)
    return rows.mapInArrow(merged, "part int, stem string, term string, block bigint, n_docs int, places array<bigint>")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of ``id, words`` the number of words."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(b.column(1).offsets.to_numpy()), pa.int32())], ["id", "n_words"])


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _committed(self, df: DataFrame) -> DataFrame:
        return df.join(self._read("batches", "batch string"), "batch", "left_semi")

    def documents(self) -> DataFrame:
        """``id, n_words`` of what is indexed."""
        return self._committed(self._read("documents", "id bigint, n_words int, batch string")).drop("batch")

    def terms(self) -> DataFrame:
        """``term, n_docs, n_places`` of every word."""
        rows = self._committed(self._read("postings", POSTING))
        return rows.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum(F.size("places")).alias("n_places"))

    def append(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Index the documents whose ids are new."""
        batch = uuid.uuid4().hex
        fresh = docs
        if not self._read("batches", "batch string").isEmpty():  # the first batch needs no join, which would shuffle every text
            fresh = docs.join(self.documents().select(F.col("id").alias("_known")), F.col(id_col).cast("long") == F.col("_known"), "left_anti")
        rows = postings(fresh, id_col, text_col).select("stem", "term", "block", "n_docs", "places", "part").withColumn("batch", F.lit(batch))
        rows = rows.sortWithinPartitions("part", "stem", "term", "block")
        rows.write.mode("append").option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/postings")
        sizes = lowered(fresh, id_col, text_col).mapInArrow(lambda batches: counted(worded(batches)), "id bigint, n_words int").groupBy("id").agg(F.sum("n_words").cast("int").alias("n_words"))
        sizes.withColumn("batch", F.lit(batch)).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/documents")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/batches")

    def lookup(self, keys: list[str], by: str = "stem") -> DataFrame:
        """The posting rows of stems (or words as they are, by ``term``)."""
        asked = self.spark.createDataFrame([(k,) for k in keys], "key string").select(part_of(stem(F.col("key")) if by == "term" else F.col("key")))
        parts = [r[0] for r in asked.distinct().collect()]  # of the few words asked for
        return self._committed(self._read("postings", POSTING).where(F.col("part").isin(parts) & F.col(by).isin(keys)))

    def _arrays(self, groups: list[list[str]], by: str) -> DataFrame:
        """``block, g, starts``: where each group's words follow one another, by block."""
        asked: dict[str, list[tuple[int, int]]] = {}
        for g, said in enumerate(groups):
            for shift, word in enumerate(said):
                asked.setdefault(word, []).append((g, shift))
        slots = F.create_map(*(x for w, at in asked.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(g).alias("g"), F.lit(s).alias("shift")) for g, s in at)))))
        rows = self.lookup(list(asked), by).select("block", "places", F.explode(slots[F.col(by)]).alias("slot")).select("block", "slot.g", "slot.shift", "places")
        # one stem has several surface words and batches
        slot = rows.groupBy("block", "g", "shift").agg(F.flatten(F.collect_list("places")).alias("places"))
        slot = slot.select("block", "g", "shift", F.transform("places", lambda p: p - F.col("shift")).alias("places"))
        sizes = F.array(*(F.lit(len(said)) for said in groups))
        joined = slot.groupBy("block", "g").agg(F.collect_list("places").alias("all")).where(F.size("all") == F.get(sizes, F.col("g")))
        return joined.select("block", "g", F.aggregate("all", F.get("all", F.lit(0)), F.array_intersect).alias("starts"))

    def counts(self, words_: list[str], *, phrases: list[list[str]] | None = None, none_of: list[str] | None = None, by: str = "stem") -> DataFrame:
        """``id, counts``: the documents that hold every word and phrase and none of the others, and how often they hold
        each of the words and then of the phrases."""
        groups = [[w] for w in words_] + (phrases or [])
        wanted = len(groups)
        if not wanted:
            raise ValueError("name at least one word or phrase")
        arrays = self._arrays(groups + [[w] for w in none_of or []], by)
        docs = F.array_distinct(F.transform("starts", lambda p: F.shiftright(p, 32)))
        block = arrays.withColumn("docs", docs).groupBy("block").agg(
            F.collect_list(F.when(F.col("g") < wanted, F.col("docs"))).alias("with"), F.flatten(F.collect_list(F.when(F.col("g") >= wanted, F.col("docs")))).alias("without"),
            F.collect_list(F.when(F.col("g") < wanted, F.struct("g", "starts"))).alias("told")).where(F.size("with") == wanted)
        kept = block.withColumn("found", F.array_except(F.aggregate("with", F.get("with", F.lit(0)), F.array_intersect), "without")).where(F.size("found") > 0)
        marks = F.struct(F.lit(-1).alias("g"), F.transform("found", lambda o: F.shiftleft(o, 32)).alias("starts"))  # of the documents found
        places = kept.select("block", F.inline(F.concat("told", F.array(marks)))).select("block", "g", F.explode("starts").alias("p")).withColumn("off", F.shiftright("p", 32))
        n = places.groupBy("block", "off", "g").agg(F.count("*").alias("n")).groupBy("block", "off").agg(F.array_sort(F.collect_list(F.struct("g", "n"))).alias("n"))
        n = n.where(F.get("n", F.lit(0))["g"] == -1).withColumn("n", F.slice("n", 2, wanted))
        return n.select((F.col("block") * (1 << BITS) + F.col("off")).alias("id"), F.transform("n", lambda x: x["n"]).alias("counts"))

    def matching(self, words_: list[str], *, phrases: list[list[str]] | None = None, none_of: list[str] | None = None, by: str = "stem") -> DataFrame:
        """``id`` of every document that holds every word and phrase and none of the others."""
        groups = [[w] for w in words_] + (phrases or [])
        arrays = self._arrays(groups + [[w] for w in none_of or []], by).withColumn("docs", F.array_distinct(F.transform("starts", lambda p: F.shiftright(p, 32))))
        block = arrays.groupBy("block").agg(F.collect_list(F.when(F.col("g") < len(groups), F.col("docs"))).alias("with"), F.flatten(F.collect_list(F.when(F.col("g") >= len(groups), F.col("docs")))).alias("without"))
        found = F.array_except(F.aggregate("with", F.get("with", F.lit(0)), F.array_intersect), "without")
        return block.where(F.size("with") == len(groups)).select("block", F.explode(found).alias("off")).select((F.col("block") * (1 << BITS) + F.col("off")).alias("id"))

    def scores(self, words_: list[str], **more) -> DataFrame:
        """``id, score``: the damped frequencies of the words and phrases, summed."""
        return self.counts(words_, **more).select("id", F.aggregate("counts", F.lit(0.0), lambda s, n: s + F.log1p(n.cast("double"))).alias("score"))

    def any_of(self, words_: list[str], by: str = "stem") -> DataFrame:
        """``id`` of every document that holds one of the words at least."""
        arrays = self._arrays([[w] for w in words_], by).select("block", F.transform("starts", lambda p: F.shiftright(p, 32)).alias("docs"))
        found = arrays.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("docs")))).alias("found"))
        return found.select("block", F.explode("found").alias("off")).select((F.col("block") * (1 << BITS) + F.col("off")).alias("id"))
