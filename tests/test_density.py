"""Density clusters against the plain quadratic method."""

import numpy as np
import pytest

from augury.operators import density as D

DIR = "/root/testdata/sf0.001"


def brute(ids, x, least, core):
    """All distances, all edges in order, the dendrogram, condensed from its top, the most stable clusters."""
    n = len(ids)
    far = np.array([[round(float(np.sqrt(((a - b) ** 2).sum())), 9) for b in x] for a in x])
    near = [sorted(far[i][j] for j in range(n) if j != i)[:core][-1] for i in range(n)]
    edges = sorted((max(far[i][j], near[i], near[j]), min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(n) for j in range(i))
    node = {i: ("row", i) for i in ids}
    group = {i: {i} for i in ids}
    top = None
    for key in edges:
        a, b = group[key[1]], group[key[2]]
        if a is not b:
            top = (key, node[key[1]], node[key[2]], a | b)
            for i in a | b:
                group[i], node[i] = top[3], top
    rows = lambda t: {t[1]} if t[0] == "row" else t[3]
    clusters = []  # (born, rows with lambda, kids, all rows)

    def condense(t, born):
        mine, out = [], len(clusters)
        clusters.append(None)
        every = rows(t)
        while True:
            lam = 1 / max(t[0][0], 1e-12)
            a, b = t[1], t[2]
            big = [s for s in (a, b) if len(rows(s)) >= least]
            if len(big) == 2:
                clusters[out] = (born, mine, [condense(s, lam) for s in (a, b)], every, lam)
                return out
            for s in (a, b):
                if s not in big:
                    mine += [lam] * len(rows(s))
            if not big:
                clusters[out] = (born, mine, [], every, None)
                return out
            t = big[0]

    if top is None or len(top[3]) < least:
        return dict.fromkeys(ids, D.NOISE)
    condense(top, 0.0)

    def stability(c):
        born, mine, kids, _, split = clusters[c]
        return sum(v - born for v in mine) + sum(len(clusters[k][3]) * (split - born) for k in kids)

    def select(c):
        kids = clusters[c][2]
        below = [select(k) for k in kids]
        inner, found = sum(b[0] for b in below), [f for b in below for f in b[1]]
        s = stability(c)
        return (s, [c]) if c and (not kids or round(s, 9) >= round(inner, 9)) else (inner, found)

    label = dict.fromkeys(ids, D.NOISE)
    for c in select(0)[1]:
        for i in clusters[c][3]:
            label[i] = min(clusters[c][3])
    return label


def clouds(seed, n, k, spread, grid=None):
    rng = np.random.default_rng(seed)
    x = 6 * rng.normal(size=(k, 3))[rng.integers(0, k, n)] + spread * rng.normal(size=(n, 3))
    x = np.round(x / grid) * grid if grid else x
    return x + 0.01


@pytest.mark.parametrize("seed, n, k, spread, grid, least, core, block", [
    (1, 120, 4, 0.6, None, 8, 4, 512), (2, 120, 4, 1.2, None, 5, 1, 40), (3, 90, 3, 0.8, 0.5, 5, 3, 20), (4, 100, 6, 0.5, 1.0, 4, 2, 512), (5, 60, 1, 1.0, None, 10, 5, 512), (6, 80, 5, 2.0, None, 2, 1, 30),
])
def test_against_the_plain_method(spark, monkeypatch, seed, n, k, spread, grid, least, core, block):
    x = clouds(seed, n, k, spread, grid)
    ids = [int(i) for i in np.random.default_rng(seed).permutation(n * 3)[:n]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>").repartition(3)
    compare = D.B.compare
    monkeypatch.setattr(D.B, "compare", lambda *a, **more: compare(*a, **{"block_rows": block, **more}))
    got = {r["id"]: r["cluster"] for r in D.density_clusters(df, "id", "v", least=least, core=core).collect()}
    assert got == brute(ids, x, least, core)


def test_registered_query(spark):
    from augury.plans import catalog

    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    got = {r["vec_id"]: r["cluster"] for r in catalog.QUERIES["density_clusters"](spark, DIR).collect()}
    ids = sorted(rows)
    assert got == brute(ids, np.array([rows[i] for i in ids]), 5, 3)


def test_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    assert D.density_clusters(make([]), "id", "v").collect() == []
    some = make([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 1.0])])
    assert [tuple(r) for r in D.density_clusters(some, "id", "v").collect()] == [(1, D.NOISE)]
    same = make([(i, [1.0, 2.0]) for i in range(30)])
    assert {r["cluster"] for r in D.density_clusters(same, "id", "v", least=5).collect()} == set(brute(list(range(30)), np.array([[1.0, 2.0]] * 30), 5, 5).values())
    with pytest.raises(ValueError):
        D.density_clusters(make([(i, clouds(1, 120, 4, 0.6)[i].tolist()) for i in range(120)]), "id", "v", least=4, most_clusters=1)


def test_trees_of_pairs_of_tiles_are_few_edges(spark):
    """Each pair of tiles leaves fewer edges than its rows, whatever the number of blocks in it; a row is in few pairs."""
    x = np.random.default_rng(2).normal(size=(1500, 3))
    rows = spark.createDataFrame([(i, v.tolist(), 0, 0.1) for i, v in enumerate(x)], "id long, v array<double>, zone int, core double")
    assert D.block_edges(rows).count() == 1499


def test_least_tree_of_edges_in_their_total_order():
    lo, hi, w = np.array([1, 1, 2, 5]), np.array([2, 3, 3, 6]), np.array([1.0, 1.0, 1.0, 2.0])
    assert sorted(D.least_tree(lo, hi, w).tolist()) == [0, 1, 3]


def test_least_tree_by_its_least_edges_first():
    """What the least edges join already is the whole tree; where they don't join all, all edges are looked at."""
    rng = np.random.default_rng(4)
    lo, hi = np.array([(i, j) for i in range(60) for j in range(i + 1, 60)]).T
    for w in (rng.random(len(lo)), rng.integers(0, 3, len(lo)).astype(float), np.where(hi == 59, 9.0, rng.random(len(lo)))):
        order = sorted(range(len(lo)), key=lambda e: (w[e], lo[e], hi[e]))
        head, want = list(range(60)), []
        for e in order:
            a, b = head[lo[e]], head[hi[e]]
            if a != b:
                head = [a if h == b else h for h in head]
                want.append(e)
        assert sorted(D.least_tree(lo, hi, w).tolist()) == sorted(want)


def test_many_copies_and_equal_distances(spark):
    """More copies than a row's list holds, in far groups, and rows that are all equally far apart."""
    rng = np.random.default_rng(9)
    copies = np.repeat(6 * rng.normal(size=(6, 3)), 14, axis=0)
    for x, core in ((np.vstack([copies, 6 * rng.normal(size=(20, 3))]), 3), (np.eye(40), 2)):
        ids = [int(i) for i in rng.permutation(300)[:len(x)]]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>").repartition(3)
        assert {r["id"]: r["cluster"] for r in D.density_clusters(df, "id", "v", least=5, core=core).collect()} == brute(ids, x, 5, core)


def test_joins_of_clusters_take_room_as_their_number():
    """A long chain of joins: each leaf joins what all before it have become."""
    joins = [((1.0 + i, i, i + 1), 0, i + 1) for i in range(20_000)]
    parent, keys = D.condensed(joins, list(range(20_001)))
    assert len(parent) == 2 * 20_000 and len(keys) == 20_000 and parent[0] == parent[1] == 20_001 and parent[20_001] == 20_002


def test_rows_climb_to_their_cluster(spark):
    joins = [((1.0, 3, 7), 1, 2), ((2.0, 3, 4), 2, 5), ((2.0, 3, 9), 5, 8)]
    parent, keys = D.condensed(joins, [1, 2, 5, 8])
    rows = [(1, 1, (0.5, 0, 0)), (2, 2, (1.0, 3, 7)), (3, 1, (2.0, 3, 3)), (4, 1, (2.0, 3, 4)), (5, 5, (2.0, 3, 8)), (6, 8, (2.0, 3, 9)), (7, 4, (9.0, 1, 1))]
    df = spark.createDataFrame(rows, f"id long, leaf long, level {D.KEY}")
    assert sorted(map(tuple, D.clusters_at(df, [1, 2, 5, 8], parent, keys).select("id", "node").collect())) == [(1, 0), (2, 4), (3, 4), (4, 5), (5, 5), (6, 6)]


def test_nearest_lists_spare_most_pairs_of_rows(spark):
    """Rows that their lists join are no longer compared: with one part there are no edges of blocks at all."""
    x = clouds(3, 300, 3, 0.3)
    told = D.nearest_rows(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, v array<double>, zone int"), 3)
    near, parts = D.spanning_tree(D.listed_edges(told), told.select(D.F.col("id").alias("c"), "limit"))
    n = parts.select("part").distinct().count()
    assert parts.count() == 300 and near.count() == 300 - n and n <= 30
