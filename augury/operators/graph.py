"""Graph operators on edge tables: components, layered path counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.functions.lineage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node each node is linked with. Labels spread along edges and then jump
    to the label's own label, so rounds grow with the logarithm of a component's width."""
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"u": "v", "c": "cv"}), "v").groupBy("u").agg(F.min("cv").alias("cn"))
        step = labels.join(near, "u").select("u", F.least("c", "cn").alias("c"))
        jump = step.alias("s").join(step.select(F.col("u").alias("w"), F.col("c").alias("cw")), F.col("c") == F.col("w")).select("u", F.least("c", "cw").alias("c"))
        new = cut(jump, "labels")
        moved = new.join(labels.withColumnRenamed("c", "old"), "u").where("c <> old").limit(1).count()
        labels = new
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))


def log_path_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, logn``: log of 1 + the paths that end at each node of a DAG. nodes: (node, layer), layers being few
    (years); edges: (src, dst) from a later layer to an earlier one, others don't count. Edges are written once, by layer; then one
    join and one written table a layer; sums are taken after a shift by their largest logarithm, so that no count leaves the logarithms."""
    layer_of = lambda end, name: nodes.select(F.col("node").alias(end), F.col("layer").alias(name))
    e = cut(edges.join(layer_of("src", "ls"), "src").join(layer_of("dst", "ld"), "dst").where("ls > ld"), "layered-edges", "ls", "ld")
    reach: dict = {}
    for ls, ld in e.select("ls", "ld").distinct().collect():  # pairs of layers
        reach.setdefault(ls, []).append(ld)
    known, zero = {}, F.lit(0.0)
    for (layer,) in nodes.select("layer").distinct().orderBy("layer").collect():  # layers, not rows
        now = nodes.where(F.col("layer") == layer).select("node")
        if layer not in reach:
            known[layer] = now.withColumn("logn", zero)
            continue
        # only the layers that this one's edges lead to are read again
        parts = [known[ld].withColumnRenamed("node", "dst") for ld in sorted(reach[layer])]
        before = parts[0]
        for part in parts[1:]:
            before = before.unionByName(part)
        told = e.where(F.col("ls") == layer).join(before, "dst").select(F.col("src").alias("node"), "logn")
        top = told.groupBy("node").agg(F.max("logn").alias("top"))
        sums = told.join(top, "node").groupBy("node", "top").agg(F.sum(F.exp(F.col("logn") - F.col("top"))).alias("s"))
        got = now.join(sums, "node", "left").select("node", F.coalesce(F.col("top") + F.log(F.col("s") + F.exp(-F.col("top"))), zero).alias("logn"))
        known[layer] = cut(got, "paths")
    if not known:
        return nodes.select("node", zero.alias("logn"))
    parts = list(known.values())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
