"""Block comparisons and the Gram projection against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import blocks as B
from augury.operators import cluster, gram

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=4).round(2).tolist(), int(rng.integers(0, 4)), int(rng.integers(0, 200))) for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(10)]  # repeated vectors
    rows += [(300, [1.0, 0.0, 0.0, 0.0], 9, 5), (301, None, 1, 5), (302, [0.0] * 4, 1, 5), (None, [1.0] * 4, 1, 5), (303, [1.0, 2.0, 3.0, 4.0], None, None)]
    return spark.createDataFrame(rows, "id long, v array<double>, c int, day int").repartition(3)


def vectors(table):
    rows = [r for r in table.collect() if r["id"] is not None and r["v"] and any(r["v"])]
    return rows, np.array([r["v"] for r in rows])


@pytest.mark.parametrize("size", [16, 512])
def test_blocks_meet_each_other_once(table, size):
    rows = B.usable(table, "id", "v").withColumn("zone", F.lit(0))
    pairs = B.compare(rows, rows, lambda q, x: {"a": np.repeat(q["id"], len(x["id"])), "b": np.tile(x["id"], len(q["id"]))}, "a bigint, b bigint", block_rows=size).collect()
    ids = {r["id"] for r in rows.collect()}
    assert len(pairs) == len(ids) ** 2 and {tuple(p) for p in pairs} == {(a, b) for a in ids for b in ids}


@pytest.mark.parametrize("both", [False, True])
def test_a_row_is_sent_to_few_tiles(spark, both):
    """Whatever the number of blocks of some hundred rows, a row meets its zone in a few tiles; each tile of the others once."""
    rows = spark.range(5000).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"), F.lit(0).alias("zone"))
    met = B.compare(rows, rows, lambda q, x: {"id": q["id"], "n": np.full(len(q["id"]), len(x["id"]))}, "id bigint, n bigint", both_ways=both)
    told = met.groupBy("id").agg(F.count("*").alias("tiles"), F.sum("n").alias("n")).agg(F.count("*"), F.max("tiles"), F.min("n"), F.max("n")).first()
    assert tuple(told) == (5000, 3, 5000, 5000)


def test_distances_of_near_rows_keep_their_digits():
    x = np.random.default_rng(3).normal(size=(60, 8))
    x = np.vstack([x, x[:20], x[:20] + 1e-7])
    assert np.abs(B.distances(x, x) - B.exact_distances(x, x)).max() < 1e-11


def test_silhouettes(table):
    rows, x = vectors(table)
    keep = [i for i, r in enumerate(rows) if r["c"] is not None]
    rows, x = [rows[i] for i in keep], x[keep]
    c, far = np.array([r["c"] for r in rows]), B.distances(x, x)
    got = {r["id"]: r["silhouette"] for r in B.silhouettes(table, "id", "v", "c").collect()}
    assert set(got) == {r["id"] for r in rows}
    for i, r in enumerate(rows):
        own = (c == c[i]) & (np.arange(len(c)) != i)
        b = min(far[i][c == k].mean() for k in set(c) - {c[i]})
        want = 0.0 if not own.any() else (b - far[i][own].mean()) / max(b, far[i][own].mean())
        assert got[r["id"]] == pytest.approx(want, abs=1e-9)
    assert {r["silhouette"] for r in B.silhouettes(table.withColumn("c", F.lit(1)), "id", "v", "c").collect()} == {None}
    assert B.silhouettes(table.limit(0), "id", "v", "c").collect() == []


def test_pick_k(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[9.0, 0, 1], [0, 9, 1], [-9, 0, 1], [0, -9, 1], [1, 1, 12]])
    rows = [(int(i), (centres[i % 5] + 0.3 * rng.normal(size=3)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    best, means = B.pick_k(df, "id", "v", 4, 6)
    assert best == 5 and set(means) == {4, 5, 6} and means[5] > 0.8
    assert B.pick_k(df.limit(40), "id", "v", 4, 6) == (4, {}) and B.pick_k(df.limit(0), "id", "v", 4, 6) == (2, {})
    assert [r["id"] for r in B.hashed_sample(df, "id", 7).collect()] == [r["id"] for r in B.hashed_sample(df.repartition(5), "id", 7).collect()]


def test_trustworthiness(table):
    rows, x = vectors(table)
    low, n, k = x[:, :2], len(x), 7
    df = table.withColumn("low", F.slice("v", 1, 2))
    ids = np.array([r["id"] for r in rows])
    order = lambda m: [sorted((round(d, 9), int(j)) for d, j in zip(B.distances(m[i:i + 1], m)[0], ids, strict=True) if j != ids[i]) for i in range(n)]
    high_o, low_o = order(x), order(low)
    got = {r["id"]: (r["kept"], r["penalty"]) for r in B.neighbourhoods_kept(df, "id", "v", "low", F.col("id") % 3 == 0, k).collect()}
    assert set(got) == {int(i) for i in ids if i % 3 == 0}
    penalties = []
    for i in range(n):
        if ids[i] % 3 == 0:
            rank = {j: r for r, (_, j) in enumerate(high_o[i], 1)}
            found = [j for _, j in low_o[i][:k]]
            want = sum(rank[j] <= k for j in found), sum(max(0, rank[j] - k) for j in found)
            penalties.append(want[1])
            assert got[int(ids[i])] == want
    t = B.neighbourhoods_kept(df, "id", "v", "low", F.col("id") % 3 == 0, k).agg(B.trustworthiness(None, n, k)).first()[0]
    assert t == pytest.approx(1 - 2 * sum(penalties) / (len(penalties) * k * (2 * n - 3 * k - 1)))


@pytest.mark.parametrize("days", [1, 10, 1000])
def test_nearest_before(table, days):
    rows, x = vectors(table)
    near = np.round(B.cosines(x, x), 9)
    got = {r["id"]: (r["best"], r["near"]) for r in B.nearest_before(table, "id", "v", F.col("day"), days).collect()}
    for i, r in enumerate(rows):
        if r["day"] is not None:
            able = [(-near[i, j], s["id"]) for j, s in enumerate(rows) if s["day"] is not None and (0 < r["day"] - s["day"] <= days or r["day"] == s["day"] and s["id"] < r["id"])]
            want = min(able, default=None)
            assert got.pop(r["id"]) == ((want[1], pytest.approx(-want[0], abs=1e-8)) if want else (None, None))
    assert got == {}


def test_gram_projection_against_a_dense_solver(spark):
    from augury.plans import catalog

    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], float)
    x -= x.mean(0)
    values, vectors_ = np.linalg.eigh(x @ x.T)
    want = vectors_[:, -3:][:, ::-1] * np.sqrt(values[-3:][::-1])
    got = {r["vec_id"]: r["projected"] for r in catalog.QUERIES["gram_projection"](spark, DIR).collect()}
    y = np.array([got[i] for i in ids])
    assert len(got) == len(ids) and np.allclose(np.abs((y * want).sum(0)), (want**2).sum(0), rtol=1e-6) and np.allclose((y**2).sum(0), values[-3:][::-1], rtol=1e-6)
    df = spark.createDataFrame([(i, v) for i, v in rows.items()], "id long, v array<double>")
    assert gram.projection(df, "id", "v", 2)[1] == pytest.approx((values[-2:][::-1] / (x**2).sum()).tolist(), rel=1e-6)
    # the same plane as the built-in PCA gives, which centres too
    pca = {r["id"]: r["projected"] for r in cluster.pca(df, "v", 3).select("id", "projected").collect()}
    z = np.array([pca[i] for i in ids])
    assert np.allclose(np.abs(((z - z.mean(0)) * y).sum(0)), (y**2).sum(0), rtol=1e-5)
    assert gram.projection(df.limit(0), "id", "v")[0].collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id long, v array<double>")
    assert all(np.allclose(r["projected"], 0) for r in gram.projection(same, "id", "v", 2)[0].collect())


def test_reduced_partition(spark):
    """The registered query: rows of a cluster lie, after a dense projection, nearest to their own cluster's mean direction (up to the few that a last round would move)."""
    from augury.plans import catalog

    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], float)
    x -= x.mean(0)
    values, vectors_ = np.linalg.eigh(x.T @ x)
    y = x @ vectors_[:, -8:]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    got = {r["vec_id"]: r["cluster"] for r in catalog.QUERIES["reduced_partition"](spark, DIR).collect()}
    assert sorted(got) == ids and len(set(got.values())) == 8
    own = np.array([got[i] for i in ids])
    centres = np.array([y[own == c].mean(0) / np.linalg.norm(y[own == c].mean(0)) for c in range(8)])
    assert ((y @ centres.T).argmax(1) == own).mean() > 0.97
