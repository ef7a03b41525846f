"""Hierarchical density clusters: mutual reachability, its minimum spanning tree, the condensed tree, the most stable clusters.

Everything is ordered by one total order of edges, (weight, smaller id, larger id), so equal weights leave no choice and the result
doesn't depend on partitions.

1. Each row's nearest others, some more than its core distance (that to the k-th nearest) asks for, by block products.
2. The spanning tree. Edges that no list of nearest rows has weigh no less than the list's last distance, so components take their least edge out in rounds of joins
   as long as it weighs less than the last distances of all their rows. What remains are few components: every pair of tiles finds the least edge between any two
   of them, keeps those of their tree, and of those that remain one task (or rounds again, where they are many) makes the tree. Of copies in a
   component one is compared.
3. A row's level: the edge whose weight first joins it with ``least`` rows, itself included. That is the largest of the first
   ``least - 1`` edges by which the tree grows from the row, always along its least edge out; all rows grow at once, a join a step, and a step
   needs no more than the ``least`` smallest edges of a row.
4. Edges whose both ends have smaller levels join two clusters that exist: without them the tree falls into pieces, one for each leaf of
   the condensed tree.
5. The condensed tree of the leaves, and which of its clusters are the most stable, is worked out on the driver over one row a join of two
   clusters: at most rows / least, and no more than ``most_clusters``, beyond which an error says to raise ``least``. Rows are counted and labelled by joins.

The work of 1 and 2 is rows times rows, as the method asks; nothing else grows faster than the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.functions.lineage import cut

from . import blocks as B
from .graph import components

NOISE = -1
TINY = 1e-12
KEY = "struct<w:double,lo:bigint,hi:bigint>"


#: So many of a row's nearest are told beyond those that its core distance asks for.
MORE = 6
#: So many edges between parts are one task's; more are joined in rounds.
FEW = 200_000


def nearest_rows(rows: DataFrame, k: int) -> DataFrame:
    """``id, zone, v, core, near, limit``: near are the nearest others, and no edge to any but them comes before limit (null: there are no others). A row with fewer than k others has as
    core the distance to its farthest."""
    near = B.nearest(rows, rows, k + MORE, both_ways=True)
    core = F.get("near", F.least(F.lit(k), F.size("near")) - 1)["d"]
    # others are as far as the last of the list, and of larger ids, or farther
    last = F.element_at("near", -1)
    limit = F.when(F.size("near") == k + MORE, F.struct(last["d"].alias("w"), F.least(F.col("id"), last["id"] + 1).alias("lo"), F.greatest(F.col("id"), last["id"] + 1).alias("hi")))
    return cut(rows.join(near, "id").select("id", "zone", "v", core.alias("core"), "near", limit.alias("limit")), "near")


def listed_edges(told: DataFrame) -> DataFrame:
    """``a, b, key``: the edges that lead to a row's nearest."""
    ends = told.select(F.col("id").alias("a"), "core", F.explode("near").alias("x")).select("a", "core", F.col("x.id").alias("b"), "x.d")
    ends = ends.join(told.select(F.col("id").alias("b"), F.col("core").alias("other")), "b")
    return ends.select("a", "b", F.struct(F.greatest("d", "core", "other").alias("w"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).alias("key"))


def least_tree(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> np.ndarray:
    """Which of the edges are of the spanning tree (or forest) of them all, or of what a and b tell that they join."""
    a, b = (lo, hi) if a is None or b is None else (a, b)
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    some = 8 * len(ids)
    if len(w) > 2 * some:
        # mostly the least edges join all
        light = np.flatnonzero(w <= np.partition(w, some)[some])
        if len(light) < len(w) and len(kept := least_tree(lo[light], hi[light], w[light], a[light], b[light])) == len(ids) - 1:
            return light[kept]
    order = np.lexsort((hi, lo, w))
    x_, y_ = ends[:len(lo)][order].tolist(), ends[len(lo):][order].tolist()
    head, left, kept = list(range(len(ids))), len(ids) - 1, []
    for e, x, y in zip(order.tolist(), x_, y_, strict=True):
        while head[x] != x:
            head[x] = x = head[head[x]]
        while head[y] != y:
            head[y] = y = head[head[y]]
        if x != y:
            head[x] = y
            kept.append(e)
            left -= 1
            if not left:
                break
    return np.array(kept, int)


def least_between(q: B.Block, x: B.Block, i: int, j: int, d: np.ndarray, off: float) -> dict[str, np.ndarray]:
    """Of a patch of squared distances, rows and columns sorted by ``part``: the least edge between any two parts. Products tell which cells can hold it."""
    rows, columns = ({c: v[s:s + n] for c, v in b.items()} for b, s, n in ((q, i, d.shape[0]), (x, j, d.shape[1])))
    np.maximum(d, rows["core"][:, None] ** 2, out=d)
    np.maximum(d, columns["core"][None, :] ** 2, out=d)
    starts = lambda p: np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    up, across = starts(rows["part"]), starts(columns["part"])
    wide = np.diff(across, append=d.shape[1])
    level = np.repeat(np.arange(len(up)), np.diff(up, append=d.shape[0]))
    low = np.minimum.reduceat(d, across, axis=1)
    other = rows["part"][:, None] != columns["part"][across][None, :]
    low[~other] = np.inf
    most = B.upto(np.minimum.reduceat(low, up, axis=0), off)
    r, s = np.nonzero((low <= most[level]) & other)
    n = wide[s]
    c = np.repeat(across[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
    r, top = np.repeat(r, n), np.repeat(most[level[r], s], n)
    able = d[r, c] <= top
    r, c = r[able], c[able]
    w = np.maximum(np.maximum(B.cell_distances(rows["v"][r], columns["v"][c]), rows["core"][r]), columns["core"][c])
    one, two, a, b = rows["id"][r], columns["id"][c], rows["part"][r], columns["part"][c]
    edges = {"lo": np.minimum(one, two), "hi": np.maximum(one, two), "w": w, "a": np.minimum(a, b), "b": np.maximum(a, b)}
    order = np.lexsort((edges["hi"], edges["lo"], w, edges["b"], edges["a"]))
    edges = {c: v[order] for c, v in edges.items()}
    first = np.concatenate([[True], (edges["a"][1:] != edges["a"][:-1]) | (edges["b"][1:] != edges["b"][:-1])])[:len(order)]
    return {c: v[first] for c, v in edges.items()}


def block_edges(rows: DataFrame) -> DataFrame:
    """``lo, hi, w, a, b``: of every pair of tiles the spanning tree (or forest) of the ``part``s that the rows belong to, which are the rows themselves if not told;
    a and b are the parts that an edge joins."""
    rows = rows if "part" in rows.columns else rows.withColumn("part", F.col("id"))

    def tree(q: B.Block, x: B.Block) -> dict:
        same = len(q["id"]) == len(x["id"]) and (q["id"] == x["id"]).all()
        q, x = ({c: v[np.argsort(b["part"], kind="stable")] for c, v in b.items()} for b in (q, x))
        off = B.blur(q["v"], x["v"])
        found: list[dict] = []

        def reduced() -> dict:
            edges = {c: np.concatenate([f[c] for f in found] or [np.zeros(0, float if c == "w" else np.int64)]) for c in ("lo", "hi", "w", "a", "b")}
            kept = least_tree(*edges.values())
            return {c: v[kept] for c, v in edges.items()}

        def wanted(i: int, j: int) -> bool:
            up, across = q["part"][i:i + B.TALL], x["part"][j:j + B.WIDE]
            return not (same and j + B.WIDE <= i) and not up[0] == up[-1] == across[0] == across[-1]

        for i, j, d in B.patches(q["v"], x["v"], wanted):
            found.append(least_between(q, x, i, j, d, off))
            if sum(len(f["w"]) for f in found[1:]) > 500_000:
                found = [reduced()]
        return reduced()

    return B.compare(rows, rows, tree, "lo bigint, hi bigint, w double, a bigint, b bigint", both_ways=True, whole=True)


def spanning_tree(edges: DataFrame, limits: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``key`` of the tree's edges, a struct (w, lo, hi), in rounds of least edges out of ``a`` and ``b``. limits (``c, limit``): edges out of c that are not given come at limit or later (null: all are
    given), so only earlier ones are taken; and ``c, part``, the parts of the tree that this leaves."""
    none = edges.select("key").where("false")
    left = cut(edges.select("a", "b", "key"), "edges")
    taken, parts = none, None if limits is None else limits.select("c", F.col("c").alias("part"))
    while left.limit(1).count():
        ends = left.select("key", F.col("a").alias("c"), F.col("b").alias("to")).unionByName(left.select("key", F.col("b").alias("c"), F.col("a").alias("to")))
        best = ends.groupBy("c").agg(F.min(F.struct("key", "to")).alias("x")).select("c", "x.key", "x.to")
        if limits is not None:
            best = best.join(limits, "c").where("limit IS NULL OR key < limit").drop("limit")
        best = cut(best, "least-edges")
        if not best.limit(1).count():
            break
        taken = taken.unionByName(best.select("key").distinct())
        # of two that chose each other the smaller is a root; so is one that chose none
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        heads = best.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("head"))
        heads = cut(heads.distinct(), "heads")
        while True:
            above = heads.select(F.col("c").alias("head"), F.col("head").alias("upper"))
            jumped = cut(heads.join(above, "head", "left").select("c", F.coalesce("upper", "head").alias("head"), F.coalesce(F.col("upper") != F.col("head"), F.lit(False)).alias("moved")), "heads")
            heads = jumped.select("c", "head")
            if not jumped.where("moved").limit(1).count():
                break
        headed = lambda df, c: df.join(heads.select(F.col("c").alias(c), "head"), c, "left").withColumn(c, F.coalesce("head", c)).drop("head")
        left = headed(headed(left, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key")
        left = cut(left.groupBy("a", "b").agg(F.min("key").alias("key")), "edges")
        if limits is not None:
            limits = cut(headed(limits, "c").groupBy("c").agg(F.min("limit").alias("limit")), "limits")
            parts = cut(headed(parts, "part"), "parts")
    return taken, parts


def whole_tree(rows: DataFrame, core: int) -> DataFrame:
    """``key`` of the edges of the spanning tree of all rows."""
    told = nearest_rows(rows, core)
    near, parts = spanning_tree(listed_edges(told), told.select(F.col("id").alias("c"), "limit"))
    if parts.select("part").distinct().limit(2).count() < 2:
        return near
    # of copies in a part, which have one core, the smallest id makes the least edges
    rows = told.select("id", "zone", "v", "core").join(parts.withColumnRenamed("c", "id"), "id").groupBy("part", "v").agg(F.min("id").alias("id"), F.min("zone").alias("zone"), F.min("core").alias("core"))
    far = cut(block_edges(cut(rows, "parts")), "far")
    if far.limit(FEW + 1).count() > FEW:
        return near.unionByName(spanning_tree(far.select("a", "b", F.struct("w", "lo", "hi").alias("key")))[0])

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(batches):
            edges = pa.Table.from_batches(found)
            yield from edges.take(pa.array(least_tree(*(c.to_numpy() for c in edges.columns)))).to_batches()

    few = far.coalesce(1).mapInArrow(tree, "lo bigint, hi bigint, w double, a bigint, b bigint")
    return near.unionByName(few.select(F.struct("w", "lo", "hi").alias("key")))


def levels(tree: DataFrame, least: int) -> DataFrame:
    """``id, level``: the edge that first joins a row with ``least`` rows; rows of smaller trees have none."""
    ends = tree.select(F.col("key.lo").alias("id"), F.col("key.hi").alias("to"), "key").unionByName(tree.select(F.col("key.hi").alias("id"), F.col("key.lo").alias("to"), "key"))
    ranked = ends.groupBy("id", F.pmod(F.xxhash64("to"), F.lit(16)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(F.struct("key", "to"))), 1, least).alias("some"))
    edges = cut(ranked.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, least).alias("edges")), "adjacency")
    front = lambda xs, of: F.transform(xs, lambda x: F.struct(x["key"].alias("key"), x["to"].alias("to"), of.alias("of")))
    state = edges.select("id", front(F.col("edges"), F.col("id")).alias("front"), F.lit(None).cast(KEY).alias("level"))
    for step in range(least - 1):
        # grown to step + 1 rows
        first = F.get("front", F.lit(0))
        grown = state.where(F.size("front") > 0).select("id", F.greatest("level", first["key"]).alias("level"), first["to"].alias("at"), first["of"].alias("came"), F.slice("front", 2, least).alias("front"))
        if step == least - 2:
            return grown.select("id", "level")
        more = grown.join(edges.select(F.col("id").alias("at"), "edges"), "at")
        fresh = front(F.filter("edges", lambda x: x["to"] != F.col("came")), F.col("at"))
        state = cut(more.select("id", "level", F.slice(F.array_sort(F.concat("front", fresh)), 1, least).alias("front")), "growing")
    return state.select("id", "level").where("false")


def condensed(joins: list[tuple[tuple, int, int]], leaves: list[int]) -> tuple[dict[int, int], dict[int, tuple]]:
    """joins: (key, a leaf of each side), in any order. Clusters are numbered: leaves as given by position, then each join's. Each cluster's parent; the key of each join's cluster."""
    number = {leaf: i for i, leaf in enumerate(leaves)}
    head, cluster = list(range(len(leaves))), list(range(len(leaves)))

    def top(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    parent, keys = {}, {}
    for fresh, (key, a, b) in enumerate(sorted(joins), len(leaves)):
        x, y = top(number[a]), top(number[b])
        parent[cluster[x]] = parent[cluster[y]] = fresh
        head[y] = x
        cluster[x], keys[fresh] = fresh, key
    return parent, keys


def clusters_at(inside: DataFrame, leaves: list[int], parent: dict[int, int], keys: dict[int, tuple]) -> DataFrame:
    """``id, node, w``, w being the level's: the cluster that a row is in from its level on, the last of its leaf's ancestors that is not formed later. Rows climb by powers of two."""
    known, n = np.array(leaves), len(leaves) + len(keys)
    above = np.array([parent.get(c, -1) for c in range(n)], np.int32)
    w, lo, hi = (np.array([keys[c][i] if c in keys else 0 for c in range(n)], t) for i, t in enumerate((float, np.int64, np.int64)))

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ups = [above]
        while (ups[-1] >= 0).any():
            ups.append(np.where(ups[-1] >= 0, ups[-1][ups[-1]], -1))
        for part in batches:
            ids, leaf, lw, llo, lhi = (c.to_numpy(zero_copy_only=False) for c in part.columns)
            at = np.minimum(np.searchsorted(known, leaf), len(known) - 1)
            some = known[at] == leaf
            ids, node, lw, llo, lhi = ids[some], at[some].astype(np.int32), lw[some], llo[some], lhi[some]
            for up in reversed(ups):
                to = up[node]
                formed = (w[to] < lw) | ((w[to] == lw) & ((lo[to] < llo) | ((lo[to] == llo) & (hi[to] <= lhi))))
                node = np.where((to >= 0) & formed, to, node)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(node, pa.int32()), pa.array(lw)], names=["id", "node", "w"])

    return inside.select("id", "leaf", "level.w", "level.lo", "level.hi").mapInArrow(climb, "id bigint, node int, w double")


def most_stable(parent: dict[int, int], keys: dict[int, tuple], own: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each cluster the selected one that it belongs to, NOISE without. own: rows that join a cluster itself, and the sum of their 1 / weight."""
    every = sorted({*own, *keys, *parent})
    lam = lambda key: 1 / max(key[0], TINY)
    born = {c: lam(keys[parent[c]]) if c in parent else 0.0 for c in every}
    size, stable, best = {}, {}, {}
    kids: dict[int, list[int]] = {c: [] for c in every}
    for c, p in parent.items():
        kids[p].append(c)
    chosen = set()
    for c in every:  # children have smaller numbers
        n, total = own.get(c, (0, 0.0))
        below = sum(size[k] for k in kids[c])
        size[c] = n + below
        stable[c] = total - n * born[c] + (below * (lam(keys[c]) - born[c]) if below else 0.0)
        inner = sum(best[k] for k in kids[c])
        if c in parent and (not kids[c] or round(stable[c], 9) >= round(inner, 9)):
            best[c] = stable[c]
            chosen.add(c)
        else:
            best[c] = inner
    label = {}
    for c in reversed(every):
        above = label.get(parent.get(c), NOISE)
        label[c] = above if above != NOISE else c if c in chosen else NOISE
    return label


def density_clusters(df: DataFrame, id_col: str, vec_col: str, *, least: int = 10, core: int = 5, most_clusters: int = 200_000) -> DataFrame:
    """``id_col, cluster``: the smallest id of the row's cluster, NOISE for rows in none. Rows without id or direction take no part; where no
    two clusters part, all is noise. Ids are whole numbers and unique."""
    if least < 2 or core < 1:
        raise ValueError("clusters have two rows at least, cores one neighbour")
    spark = df.sparkSession
    rows = B.usable(df, id_col, vec_col).withColumn("zone", F.lit(0))
    tree = cut(whole_tree(rows, core), "tree")
    at = cut(levels(tree, least), "levels")
    named = lambda c: at.select(F.col("id").alias(f"key_{c}"), F.col("level").alias(c))
    told = tree.withColumns({"key_lo": F.col("key.lo"), "key_hi": F.col("key.hi")}).join(named("lo").withColumnRenamed("lo", "l1"), "key_lo", "left").join(named("hi").withColumnRenamed("hi", "l2"), "key_hi", "left")
    told = cut(told.select("key", F.coalesce((F.col("l1") < F.col("key")) & (F.col("l2") < F.col("key")), F.lit(False)).alias("joins")), "told")
    pieces = components(told.where("NOT joins").select(F.col("key.lo").alias("a"), F.col("key.hi").alias("b"))).withColumnsRenamed({"node": "id", "component": "leaf"})
    end = lambda c: pieces.select(F.col("id").alias(c), F.col("leaf").alias(f"{c}_leaf"))
    joined = told.where("joins").select("key", F.col("key.lo").alias("x"), F.col("key.hi").alias("y")).join(end("x"), "x").join(end("y"), "y").select("key", "x_leaf", "y_leaf")
    found = joined.limit(most_clusters + 1).collect()
    if len(found) > most_clusters:
        raise ValueError(f"more than {most_clusters} joins of clusters; a larger least makes fewer")
    everyone = rows.select(F.col("id").alias(id_col))
    if not found:
        return everyone.withColumn("cluster", F.lit(NOISE).cast("long"))
    leaves = sorted({r[c] for r in found for c in ("x_leaf", "y_leaf")})
    parent, keys = condensed([(tuple(r["key"]), r["x_leaf"], r["y_leaf"]) for r in found], leaves)
    placed = clusters_at(at.join(pieces, "id"), leaves, parent, keys)
    placed = cut(placed.select("id", "node", (1 / F.greatest(F.col("w"), F.lit(TINY))).alias("lam")), "placed")
    own = {r["node"]: (r["n"], r["s"]) for r in placed.groupBy("node").agg(F.count("*").alias("n"), F.sum("lam").alias("s")).collect()}  # a row a cluster
    labels = F.broadcast(spark.createDataFrame(list(most_stable(parent, keys, own).items()), "node int, chosen int"))
    members = placed.join(labels, "node").where(F.col("chosen") != NOISE)
    names = members.groupBy("chosen").agg(F.min("id").alias("cluster"))
    named_ = members.join(names, "chosen").select(F.col("id").alias(id_col), "cluster")
    return everyone.join(named_, id_col, "left").select(id_col, F.coalesce("cluster", F.lit(NOISE).cast("long")).alias("cluster"))
