"""The corpus pipeline: documents through five operators, each stage's rows written as Parquet and read again
as the next one's input.

1. quality      rejects documents whose quality score is under 0.5
2. toxicity     rejects documents whose toxicity score is 0.5 or more
3. near_copies  keeps of each component of the n-gram Jaccard join its document of smallest id
4. decontaminate  rejects documents that hold a benchmark window
5. pieces       encodes and decodes what is left

Stages 1 to 4 return the columns of their input. Null and empty texts go through every stage by the rules of its
operator. Rows with the same id and text count as one document in stage 3; rows that share an id, a null one
included, and not the text are different documents in stages 3 and 4. Of documents that share a component and
its smallest id the one whose text hashes lowest stays; a null id is larger than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.llm import decontam, jaccard, quality, toxicity
from augury.llm.common import crc32_mod, saved, table, unused
from augury.llm.queries import piece_digests
from augury.operators.stages import Manifest, files_digest, run_stages


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc32_mod("doc_id", 3) != 1)
    return quality.score_texts(docs, model, score_col="_score").where("_score >= 0.5").drop("_score")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc32_mod("doc_id", 5) != 0)
    return toxicity.score_texts(docs, model, score_col="_score").where("_score < 0.5").drop("_score")


def with_document(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that names the document of each row, and that column's name: rows of the same id and text
    are one document, and rows that share only an id (null too) are not. Smaller ids order first, null ids last."""
    name = unused(docs, "_document")
    return docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))), name


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given, document = with_document(docs)
    found = jaccard.link_components(given, id_col=document)
    heads = found.where(F.col(document) == F.col("component_id")).select(document).distinct()
    kept = given.join(heads, document, "left_semi").select(*docs.columns)
    # the rows of a head: the same id and text
    once = F.row_number().over(W.partitionBy("doc_id", "text").orderBy("doc_id"))
    number = unused(docs, "_n")
    return kept.withColumn(number, once).where(F.col(number) == 1).drop(number)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given, document = with_document(docs)
    found = decontam.find_windows(given, table(spark, sf_dir, "benchmark"), id_col=document)
    leaks = found.where("n_hit > 0").select(document).distinct()
    return given.join(leaks, document, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_digests(docs)


STAGES = [("quality", keep_quality), ("toxicity", keep_civil), ("near_copies", keep_distinct), ("decontaminate", keep_clean), ("pieces", encode)]
#: The classifiers, the graph's components and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs


def resume(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """run(), with every stage's table in a manifest under its inputs' files: after a crash it goes on at the first stage that hasn't finished, and tables of other
    inputs are emptied once all have. The folder is the shared one unless given."""
    tables = {n: table(spark, sf_dir, n) for n in ("documents", "labels", "benchmark")}
    manifest, inputs = Manifest(spark, folder), "|".join(files_digest(df) for df in tables.values())
    bound = [(name, lambda docs, stage=stage: stage(spark, docs, sf_dir)) for name, stage in STAGES[:-1]]
    docs = run_stages(manifest, "corpus", inputs, tables["documents"], bound, {}, retire=True)
    return STAGES[-1][1](spark, docs, sf_dir)
