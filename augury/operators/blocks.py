"""Comparisons of rows with rows by block products.

Rows and queries are packed in blocks of some hundred, and blocks in tiles; tiles that share a zone meet in a cogroup with a key for each pair,
and a pair is some matrix products in one task, of which only sums, counts or the best of each query go on. A tile is a share of its
zone, so that a row is sent to about as many tasks whatever the size of the table, up to the numbers that a task may hold (``CELLS``); beyond, tiles
get more. A zone (all rows, or a stretch of time) of any size is many pairs of tiles, so no task holds it. The work is rows times queries of a
zone, which the operators that call this ask for; memory is two tiles a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from augury.functions.lineage import cut
from augury.functions.vectors import doubles, norm

#: A block's columns: ids, a matrix, and further columns by name.
Block = dict[str, np.ndarray]


#: Rows of a block; the least rows of a tile; numbers in a tile; pairs of tiles of a zone, as long as tiles may grow.
BLOCK, LEAST, CELLS, PAIRS = 512, 2048, 1 << 22, 128


def _sizes(df: DataFrame, out: str) -> DataFrame:
    """``zone``, its rows and their dimensions. One row a zone: all rows, or stretches of time, whose number the calendar bounds."""
    return df.groupBy("zone").agg(F.count("*").alias(out), F.max(F.size("v")).alias(f"{out}_dims"))


def _tiled(queries: DataFrame, rows: DataFrame, given: int | None) -> DataFrame:
    """``zone, nq, nx``: into how many tiles the queries and the rows of each zone go; of about so many rows, if given."""
    sizes = _sizes(queries, "q").join(F.broadcast(_sizes(rows, "x")), "zone")
    even = F.greatest(F.lit(LEAST), F.sqrt(F.col("q").cast("double") * F.col("x") / PAIRS))
    tile = F.lit(given) if given else F.greatest(F.lit(BLOCK), F.least(even, F.lit(CELLS) / F.greatest("q_dims", "x_dims", F.lit(1))))
    return sizes.select("zone", *(F.ceil(F.col(n) / tile).cast("int").alias(f"n{n}") for n in "qx"))


def _packed(df: DataFrame, sizes: DataFrame, own: str, columns: list[str]) -> DataFrame:
    """``zone, at, b`` and the sizes: blocks of about so many rows, in order of their first column, and the tile they are in; a zone's rows are dealt by a hash."""
    n = df.groupBy("zone").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = df.join(F.broadcast(sizes.join(F.broadcast(n), "zone")), "zone").withColumn("block", F.pmod(F.xxhash64("id"), F.greatest("blocks", own)).cast("int"))
    kept = [c for c in sizes.columns if c != "zone"]
    return dealt.groupBy("zone", "block", *kept).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("b")).select("zone", F.pmod("block", F.col(own)).alias("at"), *kept, "b")


def _block(found: pa.StructArray) -> Block:
    out = {}
    for i, f in enumerate(found.type):
        child = found.field(i)
        if pa.types.is_list(f.type) and f.name == "v":
            out["v"] = child.flatten().to_numpy(zero_copy_only=False).reshape(len(child), -1).astype(float)
        else:
            out[f.name] = np.array(child.to_pylist(), object) if pa.types.is_list(f.type) else child.to_numpy(zero_copy_only=False)
    return out


def compare(queries: DataFrame, rows: DataFrame, f: Callable[[Block, Block], dict[str, np.ndarray | list]], schema: str, *, both_ways: bool = False, whole: bool = False, block_rows: int | None = None) -> DataFrame:
    """f of some queries of a tile with all rows of a tile, for every pair of tiles of queries and rows that share a zone. Both have ``id``, ``zone`` and
    ``v`` (arrays of numbers of one length) and may have more columns. both_ways: queries and rows are the same, so a pair of tiles is sent once and f
    sees it both ways. whole: f sees a pair of tiles once, with all queries at once; a tile's pair with itself is the same block twice. block_rows:
    about how many rows a tile has, if not as many as suit."""
    columns = lambda df: [c for c in df.columns if c != "zone"]
    sizes = _tiled(queries, rows, block_rows)
    upto = lambda low, high: F.explode(F.sequence(low, high))
    zero, at = F.lit(0), F.col("at")
    # a key for each pair of tiles, so that pairs spread over tasks however few zones there are
    asked = _packed(queries, sizes, "nq", columns(queries)).select("zone", at.alias("i"), upto(at if both_ways else zero, F.col("nx") - 1).alias("j"), "b")
    held = _packed(rows, sizes, "nx", columns(rows)).select(F.col("zone").alias("z"), upto(zero, at if both_ways else F.col("nq") - 1).alias("k"), at.alias("l"), F.col("b").alias("x"))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            q, x = (_block(pa.concat_arrays([c.flatten() for c in side.column(-1).chunks])) for side in (left, right))
            for one, other in [(q, x), (x, q)] if both_ways and not whole and key[1].as_py() != key[2].as_py() else [(q, x)]:
                step = len(one["id"]) if whole else max(1, CELLS // len(other["id"]))
                for s in range(0, len(one["id"]), step):
                    found = f({c: v[s:s + step] for c, v in one.items()}, other)
                    out.append(pa.RecordBatch.from_arrays([pa.array(found[c.name], c.type) for c in arrow], schema=arrow))
        return pa.Table.from_batches(out, arrow)

    return asked.groupBy("zone", "i", "j").cogroup(held.groupBy("z", "k", "l")).applyInArrow(run, schema)


def usable(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """``id, v`` and more, of rows with an id and a direction. Floats stay floats on their way to a task."""
    kind = df.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col) if kind == "array<float>" else doubles(vec_col)
    return df.where(F.col(id_col).isNotNull() & (norm(vec_col) > 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *more)


def exact_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, from differences, a few queries at a time: the same bits whatever rows stand beside."""
    return np.vstack([np.zeros((0, len(x))), *(np.sqrt(((q[i:i + 16, None, :] - x[None, :, :]) ** 2).sum(2)) for i in range(0, len(q), 16))])


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, by products to a relative 1e-12; from differences where rows are so near that a product would lose digits."""
    whole = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
    far = whole - 2 * (q @ x.T)
    i, j = np.nonzero(far < 0.01 * whole)
    for s in range(0, len(i), 1 << 16):
        a, b = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
        far[a, b] = ((q[a] - x[b]) ** 2).sum(1)
    return np.sqrt(far)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T


def silhouettes(df: DataFrame, id_col: str, vec_col: str, cluster_col: str) -> DataFrame:
    """``id, cluster, a, b, silhouette``: mean distance to the own cluster's others, the least mean distance to another cluster, and (b - a) / max(a, b);
    0 for a cluster of one row, null where there is but one cluster."""
    rows = usable(df, id_col, vec_col, F.col(cluster_col).cast("long").alias("cluster")).where("cluster IS NOT NULL").withColumn("zone", F.lit(0))

    def sums(q: Block, x: Block) -> dict:
        far = distances(q["v"], x["v"])
        order = np.argsort(x["cluster"], kind="stable")
        groups, start, n = np.unique(x["cluster"][order], return_index=True, return_counts=True)
        total = np.add.reduceat(far[:, order], start, axis=1)
        return {"id": np.repeat(q["id"], len(groups)), "cluster": np.repeat(q["cluster"], len(groups)), "other": np.tile(groups, len(q["id"])), "total": total.ravel(), "n": np.tile(n, len(q["id"]))}

    each = compare(rows, rows, sums, "id bigint, cluster bigint, other bigint, total double, n bigint", both_ways=True).groupBy("id", "cluster", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("cluster") == F.col("other")
    per = each.groupBy("id", "cluster").agg(F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.withColumn("silhouette", s)


def hashed_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The rows whose ids hash lowest: a bounded sample that doesn't depend on the order or partitions of the table."""
    return df.orderBy(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)), id_col).limit(rows)


def pick_k(df: DataFrame, id_col: str, vec_col: str, low: int, high: int, *, sample: int = 4000, seed: int = 42) -> tuple[int, dict[int, float]]:
    """The number of clusters with the best mean silhouette, and the means. Clusters are fitted and judged on a sample of at most ``sample``
    rows, as the operator is defined; below 60 rows there is nothing to choose."""
    from .cluster import cosine_kmeans

    some = cut(hashed_sample(usable(df, id_col, vec_col).select("id", "v"), "id", sample), "silhouette-sample")
    n = some.count()
    if n < 60:
        return max(2, min(low, n // 8)), {}
    found = {}
    for k in range(low, min(high, max(low, n // 10)) + 1):
        cells = cosine_kmeans(some, "v", k, seed)[0]
        found[k] = silhouettes(cells, "id", "v", "cluster").agg(F.avg("silhouette")).first()[0] or -1.0
    return max(found, key=lambda k: (found[k], -k)), found


def best_first(far: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, digits: int = 9) -> list[list[tuple[float, int]]]:
    """Of each row of distances (rounded to so many decimals) the k least with their ids, without the own id."""
    out = []
    for d, me in zip(np.round(far, digits), own, strict=True):
        some = np.argpartition(d, min(k, len(d) - 1))[:k + 1] if len(d) > k + 1 else np.arange(len(d))
        some = np.flatnonzero(d <= d[some].max())  # with all ties
        listed = sorted((float(d[j]), int(ids[j])) for j in some if ids[j] != me)
        out.append(listed[:k])
    return out


#: Rows and columns of a patch of distances, small enough for a processor's cache.
TALL, WIDE = 256, 4096


def patches(q: np.ndarray, x: np.ndarray, wanted: Callable[[int, int], bool] = lambda i, j: True) -> Iterator[tuple[int, int, np.ndarray]]:
    """``i, j, d``: squared distances by products, some rows of q (from i on) by some of x (from j on), right to ``blur(q, x)``."""
    own = lambda m: (m * m).sum(1)[:, None]
    left, right = np.hstack([-2 * q, own(q), np.ones((len(q), 1))]), np.hstack([x, np.ones((len(x), 1)), own(x)])
    for i in range(0, len(q), TALL):
        for j in range(0, len(x), WIDE):
            if wanted(i, j):
                yield i, j, left[i:i + TALL] @ right[j:j + WIDE].T


def blur(q: np.ndarray, x: np.ndarray) -> float:
    """By how much a squared distance by products may be off."""
    return 1e-15 * (q.shape[1] + 2) * sum((m * m).sum(1).max(initial=0.0) for m in (q, x))


def upto(far: np.ndarray, off: float, digits: int = 9) -> np.ndarray:
    """Squares that none exceeds whose distance, so rounded, is at most that of these squares."""
    return (np.sqrt(np.maximum(far + off, 0.0)) + 1.1 * 10.0**-digits) ** 2 + off


def cell_distances(q: np.ndarray, x: np.ndarray, digits: int = 9) -> np.ndarray:
    """Of each row of q to the same row of x, as ``exact_distances`` has them, rounded."""
    return np.concatenate([np.zeros(0), *(np.round(np.sqrt(((q[s:s + (1 << 16)] - x[s:s + (1 << 16)]) ** 2).sum(1)), digits) for s in range(0, len(q), 1 << 16))])


def nearest_exactly(q: Block, x: Block, k: int, digits: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, d, id``: of each query (by its row) the k nearest rows, nearest first, ties by id, d from differences and rounded: products only tell which rows can be among them."""
    off, out, kept = blur(q["v"], x["v"]), [], []
    limit = np.zeros(0)

    def chosen(r: np.ndarray, c: np.ndarray, d: np.ndarray, first: int) -> None:
        other = x["id"][c] != q["id"][r + first]
        r, c, d = r[other], c[other], d[other]
        order = np.lexsort((d, r))
        r, c, d = r[order], c[order], d[order]
        starts = np.searchsorted(r, np.arange(limit.size + 1))
        last = starts[:-1] + k - 1
        most = np.where(last < starts[1:], upto(d[np.minimum(last, max(0, len(d) - 1))], off, digits) if len(d) else np.inf, np.inf)
        near = d <= most[r]
        r, c = r[near], c[near]
        e, ids = cell_distances(q["v"][r + first], x["v"][c], digits), x["id"][c]
        order = np.lexsort((ids, e, r))
        r, e, ids = r[order], e[order], ids[order]
        some = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[some] + first, e[some], ids[some]))

    for i, j, d in patches(q["v"], x["v"]):
        if j == 0:
            # with the own row there may be k + 1; those of the first rows bound those of all
            limit = upto(np.partition(d, k, axis=1)[:, k], off, digits) if d.shape[1] > k else np.full(len(d), np.inf)
            kept = []
        r, c = np.nonzero(d <= limit[:, None])
        kept.append((r, c + j, d[r, c]))
        if j + d.shape[1] == len(x["id"]):
            chosen(*(np.concatenate(m) for m in zip(*kept, strict=True)), i)
    return tuple(np.concatenate(m) for m in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))


def nearest(queries: DataFrame, rows: DataFrame, k: int, **more) -> DataFrame:
    """``id, near``: of each query the k nearest rows as (d, id), nearest first, ties by id."""

    def some(q: Block, x: Block) -> dict:
        row, d, other = nearest_exactly(q, x, k)
        return {"id": q["id"][row], "d": d, "other": other}

    told = compare(queries, rows, some, "id bigint, d double, other bigint", **more)
    return told.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("other").alias("id")))), 1, k).alias("near"))


def neighbourhoods_kept(df: DataFrame, id_col: str, high: str, low: str, asked: Column, k: int) -> DataFrame:
    """``id, kept, penalty``: of each asked row how many of its k nearest by ``low`` are among its k nearest by ``high``, and by how much the ranks of
    the others by ``high`` exceed k, in sum. Ranks are counted against all rows."""
    space = lambda vec: usable(df, id_col, vec, asked.alias("asked")).withColumn("zone", F.lit(0))
    near = {}
    for name, vec in (("high", high), ("low", low)):
        rows = space(vec)
        near[name] = nearest(rows.where("asked").drop("asked"), rows.drop("asked"), k).select("id", F.transform("near", lambda x: x["id"]).alias(name))
    lists = cut(near["high"].join(near["low"], "id"), "neighbours")
    kept = lists.select("id", F.size(F.array_intersect("high", "low")).alias("kept"), F.array_except("low", "high").alias("intruders"))
    rows = space(high).drop("asked")
    # an intruder's own distance travels with its query
    who = kept.select("id", F.explode("intruders").alias("other")).join(rows.select(F.col("id").alias("other"), F.col("v").alias("w")), "other").groupBy("id").agg(F.collect_list(F.struct("other", "w")).alias("list"))
    queries = rows.join(who, "id").select("id", "v", "zone", F.transform("list", lambda x: x["other"]).alias("others"), F.flatten(F.transform("list", lambda x: x["w"])).alias("ws"))

    def closer(q: Block, x: Block) -> dict:
        ids, counts = [], []
        for me, v, d, others, ws in zip(q["id"], q["v"], distances(q["v"], x["v"]), q["others"], q["ws"], strict=True):
            mine = np.round(exact_distances(v[None, :], np.array(ws, float).reshape(len(others), -1))[0], 9)
            own = x["id"] == me
            for o, m in zip(others, mine, strict=True):
                slack = 2e-9 + 1e-9 * m
                level = np.flatnonzero(np.abs(d - m) <= slack)  # too near to tell by products
                e = np.round(exact_distances(v[None, :], x["v"][level])[0], 9)
                ids.append(me)
                counts.append(int(((d < m - slack) & ~own).sum() + (((e < m) | ((e == m) & (x["id"][level] < o))) & ~own[level]).sum()))
        return {"id": ids, "n": counts}

    ahead = compare(queries, rows, closer, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("ahead"))
    # rank = rows ahead + 1, over all intruders of a query
    out = kept.join(ahead, "id", "left")
    m = F.size("intruders")
    return out.select("id", "kept", (F.coalesce("ahead", F.lit(0)) + m - m * k).cast("long").alias("penalty"))


def trustworthiness(kept: DataFrame, n: int, k: int) -> Column:
    """1 less the penalties' share of the largest possible, over the asked rows."""
    return 1 - F.sum("penalty") * 2 / (F.count("*") * k * (2 * n - 3 * k - 1))


def nearest_before(df: DataFrame, id_col: str, vec_col: str, day: Column, days: int) -> DataFrame:
    """``id, best, near``: for each row its most similar one, by cosine, among those of the ``days`` before it (its own day's of smaller id
    included). Rows meet in stretches of so many days: each is asked in its own stretch and held in that and the next one."""
    rows = usable(df, id_col, vec_col, day.cast("int").alias("day")).where("day IS NOT NULL")
    stretch = F.floor(F.col("day") / days)
    asked, held = rows.withColumn("zone", stretch), rows.withColumn("zone", F.explode(F.array(stretch, stretch + 1)))

    def best(q: Block, x: Block) -> dict:
        near = np.round(cosines(q["v"], x["v"]), 9)
        gap = q["day"][:, None] - x["day"][None, :]
        ok = ((gap > 0) & (gap <= days)) | ((gap == 0) & (x["id"][None, :] < q["id"][:, None]))
        near = np.where(ok, near, -np.inf)
        top = near.max(1)
        some = np.flatnonzero(top > -np.inf)
        first = [int(x["id"][near[i] == top[i]].min()) for i in some]
        return {"id": q["id"][some], "best": first, "near": top[some]}

    found = compare(asked, held, best, "id bigint, best bigint, near double").groupBy("id").agg(F.max(F.struct("near", (-F.col("best")).alias("best"))).alias("x"))
    return rows.select("id").join(found, "id", "left").select("id", (-F.col("x.best")).alias("best"), F.col("x.near").alias("near"))
