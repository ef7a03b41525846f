"""Search operators: lexical and vector top-k, rank fusion, analytics of a hit set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.text import words
from augury.functions.vectors import cosine


def lexical_scores(docs: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score``: documents that hold every term; the score is the terms' summed frequency, damped. The
    tokens are counted in place; nothing is shuffled."""
    tf = [F.size("_w") - F.size(F.array_remove("_w", t)) for t in terms]
    hits = docs.select(id_col, words(text_col).alias("_w")).where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(F.col("_w"), t)))
    return hits.select(id_col, sum((F.log1p(x.cast("double")) for x in tf), F.lit(0.0)).alias("score"))


def top_k(scores: DataFrame, k: int, id_col: str, rank: str = "rank") -> DataFrame:
    """The k best with their ranks: a top-k sort first, so the window sees k rows."""
    best = scores.orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn(rank, F.row_number().over(W.orderBy(F.desc("score"), id_col)))


def vector_scores(vectors: DataFrame, query: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return vectors.select(id_col, cosine(vec_col, query).alias("score"))


def fuse(lists: dict[str, DataFrame], id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (id, rank): ``id, score, found_by``."""
    parts = [df.select(id_col, (1.0 / (k + F.col("rank"))).alias("s"), F.lit(name).alias("by")) for name, df in lists.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(id_col).agg(F.round(F.sum("s"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("by")), "+").alias("found_by"))


def distinctive_terms(docs: DataFrame, hit: Column, *, id_col: str = "doc_id", text_col: str = "text", least: int = 3) -> DataFrame:
    """``term, hits, df, lift``: document frequency inside the hit set against all documents."""
    n = docs.agg(F.count("*").alias("n_all"), F.count_if(hit).alias("n_hit"))  # one row
    terms = docs.select(hit.alias("h"), F.explode(F.array_distinct(words(text_col))).alias("term"))
    df = terms.groupBy("term").agg(F.count_if("h").alias("hits"), F.count("*").alias("df")).where(F.col("hits") >= least)
    return df.crossJoin(n).select("term", "hits", "df", F.round((F.col("hits") / F.col("n_hit")) / (F.col("df") / F.col("n_all")), 4).alias("lift"))


def clamped_page(hits: DataFrame, order: Sequence[Column], id_col: str, size: int, clamp: int) -> DataFrame:
    """The first page of hits with ``rank``, ``total`` counted no further than one beyond clamp, and whether it was."""
    page = hits.orderBy(*order).limit(size)
    page = page.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # a page's rows
    total = F.broadcast(hits.select(F.lit(1)).limit(clamp + 1).agg(F.count("*").alias("total")))  # one row
    return page.crossJoin(total).select(id_col, "rank", "total", (F.col("total") > clamp).alias("clamped"))


def meaning_within(vectors: DataFrame, keep: DataFrame, words: DataFrame, id_col: str, score: Column, nearest: int, enough: int, most: int) -> tuple[DataFrame, bool]:
    """``id_col, score`` of the rows nearest in meaning that pass a filter (keep: their ids), and whether the fallback was taken. Of the ``nearest`` rows of all those in the filter count; if they
    are fewer than ``enough``, the rows of the filter that hold one of the query's words (words: ids) come in too, by the same score. ``most`` in all: a page's candidates."""
    scored = vectors.select(id_col, score.alias("score"))
    order = [F.desc("score"), F.col(id_col)]
    near = scored.orderBy(*order).limit(nearest).join(keep, id_col, "left_semi")
    thin = near.limit(enough).count() < enough
    if thin:
        near = near.unionByName(scored.join(keep, id_col, "left_semi").join(words, id_col, "left_semi")).distinct()
    return near.orderBy(*order).limit(most), thin
