"""Vector analytics: group means, tier centring, cosine k-means, pockets, drift between windows, probes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.vectors import cosine, doubles, norm, unit


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """``keys, mean, n``: component means; rows are aggregated per (key, component), so no group is gathered."""
    parts = df.select(*keys, F.posexplode(doubles(vec)).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"), F.count("*").alias("_n"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("mean"), F.max("_n").alias("n"))


def centred(df: DataFrame, key: str, vec: str) -> DataFrame:
    """df with vectors less their group's mean, at unit length."""
    means = mean_vectors(df, [key], vec).select(key, "mean")
    return df.join(means, key).withColumn(vec, unit(F.zip_with(doubles(vec), "mean", lambda a, b: a - b))).drop("mean")


def nearest_in_blocks(rows: DataFrame, queries: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """``query_id, id, s``: the k rows of highest cosine to each query, by exact comparison of blocks; a block keeps its own k of each query before the blocks are
    merged. Rows without direction take no part."""
    from . import blocks as B

    asked, held = (B.usable(df, id_col, vec).withColumn("zone", F.lit(0)) for df in (queries, rows))

    def some(q: B.Block, x: B.Block) -> dict:
        lists = B.best_first(-np.round(B.cosines(q["v"], x["v"]), 12), x["id"], q["id"], k, 12)
        return {"query_id": [i for i, found in zip(q["id"], lists, strict=True) for _ in found], "s": [-d for found in lists for d, _ in found], "id": [o for found in lists for _, o in found]}

    told = B.compare(asked, held, some, "query_id bigint, s double, id bigint")
    best = told.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "id"))), 1, k).alias("xs"))
    return best.select("query_id", F.inline("xs")).select("query_id", F.col("id").alias(id_col), (-F.col("o")).alias("s"))


def cosine_kmeans(df: DataFrame, vec: str, k: int, seed: int = 42, out: str = "cluster") -> tuple[DataFrame, list[list[float]]]:
    """Spherical k-means: clusters of unit vectors, and the k centres. Vectors that are null or all zero have no
    direction: they take no part and get no row."""
    data = df.where(norm(vec) > 0).withColumn("_v", array_to_vector(unit(vec)))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out, distanceMeasure="cosine", maxIter=20).fit(data)
    return model.transform(data).drop("_v"), [c.tolist() for c in model.clusterCenters()]


def pockets(df: DataFrame, id_col: str, vec: str, k: int, least: int, cohesion: float, merge: float = 0.9, seed: int = 42) -> DataFrame:
    """``id, pocket``: fine k-means, cells whose mean cosine to their centre reaches ``cohesion``, near-equal
    centres merged (k centres on the driver), pockets of at least ``least`` members; pure noise gives none."""
    spark = df.sparkSession
    cells, centres = cosine_kmeans(df, vec, k, seed)
    table = spark.createDataFrame(list(enumerate(centres)), "cluster int, c array<double>")
    near = cells.join(F.broadcast(table), "cluster").withColumn("_s", cosine(vec, "c"))  # k rows
    kept = [r["cluster"] for r in near.groupBy("cluster").agg(F.avg("_s").alias("s")).where(F.col("s") >= cohesion).collect()]
    group, parent = {}, {i: i for i in kept}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1.0)
    for i in kept:
        for j in kept:
            if i < j and dot(centres[i], centres[j]) >= merge:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    group = [(i, root(i)) for i in kept]
    members = near.join(F.broadcast(spark.createDataFrame(group, "cluster int, pocket int")), "cluster") if group else near.withColumn("pocket", F.lit(0)).where("false")
    return members.withColumn("_n", F.count("*").over(W.partitionBy("pocket"))).where(F.col("_n") >= least).select(id_col, "pocket")


def pca(df: DataFrame, vec: str, dims: int, out: str = "projected") -> DataFrame:
    data = df.withColumn("_v", array_to_vector(doubles(vec)))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(data)
    return model.transform(data).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def threshold_sweep(df: DataFrame, score: str, positive: Column, steps: Sequence[float]) -> DataFrame:
    """``threshold, tp, fp, fn`` for each threshold, in one pass."""
    counts = df.select(F.col(score).alias("s"), positive.alias("y"), F.explode(F.array(*map(F.lit, steps))).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    return counts.groupBy("threshold").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """``ari``: agreement of two labelings beyond chance."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = df.groupBy(a, b).agg(F.count("*").alias("n"))
    x = both.agg(pairs("n").alias("i"), F.sum("n").alias("total"))
    ra, rb = (both.groupBy(k).agg(F.sum("n").alias("n")).agg(pairs("n").alias(f"r{i}")) for i, k in enumerate((a, b)))
    one = x.crossJoin(ra).crossJoin(rb).withColumn("e", F.col("r0") * F.col("r1") / (F.col("total") * (F.col("total") - 1) / 2))  # one row each
    return one.select(((F.col("i") - F.col("e")) / ((F.col("r0") + F.col("r1")) / 2 - F.col("e"))).alias("ari"))
