"""Nests: dense cells of a fine partition, united where they are one, and put in groups.

Rows come with a cell (from k-means, or any other fine partition). What is computed over rows, sums of unit vectors, cosines to
centres, percentiles, is Spark's; what is computed over centres is on the driver: there are as many as cells, whose number
``cell_count`` bounds by ``most`` however many rows there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.functions.vectors import cosine, norm, unit

from .cluster import mean_vectors


def cell_count(n: int, per_cell: int = 400, least: int = 200, most: int = 1200) -> int:
    """Cells for n rows: one for every ``per_cell``, not more than ``most``; a small slice has one for every 40 rows up to
    ``least``, and eight at the least."""
    return max(8, min(least, n // 40), min(most, n // per_cell))


def _directions(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def merge_closest(sums: np.ndarray, centre: np.ndarray, raw: float, centred: float) -> list[int]:
    """For each centre (the sum of its members' unit vectors) the first centre of the nest it ends in. The pair closest after
    centring is united while one is left whose cosine reaches ``raw`` as it is and ``centred`` less the common centre; of
    equal pairs the first. The result doesn't depend on the order of rows."""
    n = len(sums)
    owner, alive, total = list(range(n)), np.ones(n, bool), sums.astype(float).copy()
    plain = _directions(total)
    apart = _directions(plain - centre)
    score = np.where((plain @ plain.T >= raw) & (apart @ apart.T >= centred), apart @ apart.T, -np.inf)
    np.fill_diagonal(score, -np.inf)
    while n and score.max() > -np.inf:
        i, j = sorted(map(int, np.unravel_index(int(np.argmax(score)), score.shape)))
        owner = [i if o == j else o for o in owner]
        total[i] += total[j]
        alive[j] = False
        plain[i] = _directions(total[i:i + 1])[0]
        apart[i] = _directions(plain[i:i + 1] - centre)[0]
        near = apart @ apart[i]
        fresh = np.where(alive & (plain @ plain[i] >= raw) & (near >= centred), near, -np.inf)
        fresh[i] = -np.inf
        score[i, :] = score[:, i] = fresh
        score[j, :] = score[:, j] = -np.inf
    return owner


def average_linkage(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of clusters by mean cosine distance, each named by its first member, by chains of nearest
    neighbours: quadratic in the vectors. Heights never fall along a branch, so a cut is a choice among merges."""
    n = len(vectors)
    unit_ = _directions(np.asarray(vectors, float))
    far = 1 - unit_ @ unit_.T
    np.fill_diagonal(far, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        row = np.where(alive, far[a], np.inf)
        row[a] = np.inf
        b = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
            del chain[-2:]
            i, j = min(a, b), max(a, b)
            merges.append((i, j, float(far[i, j])))
            far[i] = (size[i] * far[i] + size[j] * far[j]) / (size[i] + size[j])
            far[:, i] = far[i]
            far[i, i] = np.inf
            size[i] += size[j]
            alive[j] = False
            far[j, :] = far[:, j] = np.inf
        else:
            chain.append(b)
    return merges


def linked_groups(vectors: np.ndarray, weights: list[int], cut: float) -> list[int]:
    """Numbers from 1 of the groups that average linkage leaves below ``cut``: heaviest first, of equal ones the one with
    the first vector."""
    owner = list(range(len(vectors)))
    for a, b, height in sorted(average_linkage(vectors), key=lambda m: m[2]):
        if height <= cut:
            a, b = owner[a], owner[b]
            owner = [min(a, b) if o in (a, b) else o for o in owner]
    held = {o: -sum(w for w, p in zip(weights, owner, strict=True) if p == o) for o in owner}
    number = {o: i for i, o in enumerate(sorted(held, key=lambda o: (held[o], o)), 1)}
    return [number[o] for o in owner]


def _near(rows: DataFrame, key: str, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows of these keys with ``near``, the cosine to their key's centre, in ten thousandths."""
    table = rows.sparkSession.createDataFrame([(int(k), v.tolist()) for k, v in centres.items()], f"{key} int, _c array<double>")
    return rows.join(F.broadcast(table), key).withColumn("near", F.round(cosine("vec", "_c"), 4)).drop("_c")  # a row a cell


def gates(cells: list[tuple[int, float, str | None]], cohesion: float, quantile: float | None) -> set[int]:
    """The cells (id, cohesion, tier) that are dense: by a fixed bar, or by the quantile of all cells, of their own tier where it has four
    cells or more, but never under the bar."""
    if quantile is None:
        return {c for c, near, _ in cells if near >= cohesion}
    bar = lambda some: max(cohesion, float(np.quantile(some, quantile)))
    own: dict[str | None, list[float]] = {}
    for _, near, tier in cells:
        own.setdefault(tier, []).append(near)
    whole = bar([near for _, near, _ in cells]) if cells else cohesion
    return {c for c, near, tier in cells if near >= (bar(own[tier]) if tier is not None and len(own[tier]) >= 4 else whole)}


def find_nests(df: DataFrame, *, id_col: str, vec_col: str, cell_col: str, tier_col: str | None = None, cohesion: float = 0.75, quantile: float | None = None, raw: float = 0.92,
               centred: float = 0.70, least: int = 30, cut: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """``id_col, nest`` of the rows in nests, and ``nest, size, cohesion, radius_p25, group_id``. Cells of fewer than three rows have no
    density; rows without direction take no part. A nest has the number of its first cell."""
    spark = df.sparkSession
    rows = df.where(norm(vec_col) > 0).select(F.col(id_col), F.col(cell_col).cast("int").alias("cell"), (F.col(tier_col) if tier_col else F.lit(None)).cast("string").alias("tier"), unit(vec_col).alias("vec"))
    found = {r["cell"]: r for r in mean_vectors(rows, ["cell"], "vec").where("n >= 3").collect()}
    sums = {c: np.array(r["mean"]) * r["n"] for c, r in found.items()}
    whole = mean_vectors(rows.select("vec", F.lit(0).alias("one")), ["one"], "vec").first()
    empty = spark.createDataFrame([], "nest int, size bigint, cohesion double, radius_p25 double, group_id int")
    members = rows.select(id_col, F.col("cell").alias("nest"))
    if not found:
        return members.where("false"), empty
    centre = np.array(whole["mean"])
    near = _near(rows, "cell", {c: s / found[c]["n"] for c, s in sums.items()})
    dense = near.groupBy("cell").agg(F.round(F.avg("near"), 4).alias("near"), F.mode("tier", True).alias("tier")).collect()
    kept = sorted(gates([(r["cell"], r["near"], r["tier"]) for r in dense], cohesion, quantile))
    if not kept:
        return members.where("false"), empty
    owner = [kept[i] for i in merge_closest(np.array([sums[c] for c in kept]), centre, raw, centred)]
    nest_of = dict(zip(kept, owner, strict=True))
    total = {o: sum(sums[c] for c in kept if nest_of[c] == o) for o in set(owner)}
    size = {o: sum(found[c]["n"] for c in kept if nest_of[c] == o) for o in total}
    nests = sorted(o for o in total if size[o] >= least)
    if not nests:
        return members.where("false"), empty
    groups = linked_groups(_directions(np.array([total[o] for o in nests])) - centre, [size[o] for o in nests], cut)
    told = spark.createDataFrame([(c, o) for c, o in nest_of.items() if o in nests], "cell int, nest int")
    inside = rows.join(F.broadcast(told), "cell")  # a row a cell
    numbers = F.broadcast(spark.createDataFrame(list(zip(nests, groups, strict=True)), "nest int, group_id int"))
    # cosines in ten thousandths: a percentile keeps at most 20,001 counts
    shape = _near(inside, "nest", {o: total[o] for o in nests}).groupBy("nest").agg(F.count("*").alias("size"), F.round(F.avg("near"), 4).alias("cohesion"), F.round(F.percentile("near", 0.25), 4).alias("radius_p25"))
    return inside.select(id_col, "nest"), shape.join(numbers, "nest")
