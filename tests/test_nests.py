"""Merging of nests against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import nests as N

DIR = "/root/testdata/sf0.001"


def cos(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) or 1.0)


def brute_merge(sums, centre, raw, centred):
    """The closest pair, again and again, everything computed anew."""
    groups = {i: [i] for i in range(len(sums))}
    while True:
        mean = {g: [sum(sums[i][k] for i in m) for k in range(len(centre))] for g, m in groups.items()}
        unit = {g: [x / math.sqrt(sum(y * y for y in v)) for x in v] for g, v in mean.items()}
        less = {g: [x - c for x, c in zip(v, centre, strict=True)] for g, v in unit.items()}
        pairs = [(-cos(less[a], less[b]), a, b) for a in groups for b in groups if a < b and cos(unit[a], unit[b]) >= raw and cos(less[a], less[b]) >= centred]
        if not pairs:
            return [g for i in range(len(sums)) for g, m in groups.items() if i in m]
        _, a, b = min(pairs)
        groups[a] += groups.pop(b)


def brute_linkage(vectors, cut):
    """Clusters united by the least mean distance between their members while it is at most cut."""
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > 1:
        d, a, b = min((np.mean([1 - cos(vectors[i], vectors[j]) for i in x for j in y]), a, b) for a, x in enumerate(groups) for b, y in enumerate(groups) if a < b)
        if d > cut:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def clouds(seed, n, k=4, dims=5, spread=0.5):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, dims))[rng.integers(0, k, n)] + spread * rng.normal(size=(n, dims))


@pytest.mark.parametrize("seed", range(6))
def test_merge_closest(seed):
    sums = clouds(seed, 14) * (1 + np.arange(14)[:, None] % 3)
    centre = np.full(5, 0.05)
    assert N.merge_closest(sums, centre, 0.8, 0.7) == brute_merge(sums.tolist(), centre.tolist(), 0.8, 0.7)
    order = np.random.default_rng(seed).permutation(14)
    owner, other = N.merge_closest(sums, centre, 0.8, 0.7), N.merge_closest(sums[order], centre, 0.8, 0.7)
    parts = lambda o, name: {frozenset(name[i] for i in range(14) if o[i] == x) for x in o}
    assert parts(owner, range(14)) == parts(other, order.tolist())


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("cut", [0.1, 0.4, 0.7, 1.2, 2.0])
def test_average_linkage(seed, cut):
    x = clouds(seed, 15)
    groups = N.linked_groups(x, [1] * 15, cut)
    assert {frozenset(i for i in range(15) if groups[i] == g) for g in groups} == brute_linkage(x.tolist(), cut)
    heights = [h for *_, h in N.average_linkage(x)]
    assert len(heights) == 14


def test_few_vectors():
    assert N.linked_groups(np.zeros((0, 3)), [], 0.7) == [] and N.linked_groups(np.ones((1, 3)), [5], 0.7) == [1]
    assert N.linked_groups(np.array([[1.0, 0], [0, 1], [0, 2]]), [9, 1, 1], 0.7) == [1, 2, 2] and N.merge_closest(np.zeros((0, 2)), np.zeros(2), 0.9, 0.9) == []
    assert [N.cell_count(n) for n in (0, 400, 3518, 14400, 10**6, 10**9)] == [8, 10, 87, 200, 1200, 1200]


def test_gates():
    cells = [(i, i / 10, "a" if i < 5 else "b") for i in range(8)]
    assert N.gates(cells, 0.45, None) == {5, 6, 7} and N.gates(cells, 0.0, 0.75) == {3, 4, 6, 7} and N.gates([], 0.1, 0.5) == set() and N.gates(cells, 0.65, 0.1) == {7}


def test_query_against_brute_force(spark):
    """The registered query, whole, over its table."""
    from augury.plans import catalog

    rows = [(r["vec_id"], r["label"] * 4 + r["vec_id"] % 4, np.array(r["embedding"], float)) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    rows = [(i, c, v / np.linalg.norm(v)) for i, c, v in rows]
    centre = np.mean([v for *_, v in rows], axis=0)
    cells = sorted({c for _, c, _ in rows if sum(d == c for _, d, _ in rows) >= 3})
    sums = {c: sum(v for _, d, v in rows if d == c) for c in cells}
    near = {c: round(np.mean([round(cos(v, sums[c]), 4) for _, d, v in rows if d == c]), 4) for c in cells}
    kept = [c for c in cells if near[c] >= np.quantile(list(near.values()), 0.25)]
    owner = brute_merge([sums[c].tolist() for c in kept], centre.tolist(), 0.5, 0.3)
    nest = {c: kept[o] for c, o in zip(kept, owner, strict=True)}
    nests = sorted(o for o in set(nest.values()) if sum(nest.get(c) == o for _, c, _ in rows) >= 8)
    total = {o: sum(sums[c] for c in kept if nest[c] == o) for o in nests}
    groups = brute_linkage([(total[o] / np.linalg.norm(total[o]) - centre).tolist() for o in nests], 0.7)
    got = {r["nest"]: r for r in catalog.QUERIES["nest_groups"](spark, DIR).collect()}
    assert set(got) == set(nests) and len(nests) > 3
    assert {frozenset(i for i, o in enumerate(nests) if got[o]["group_id"] == g) for g in {r["group_id"] for r in got.values()}} == groups
    for o in nests:
        mine = [round(cos(v, total[o]), 4) for _, c, v in rows if nest.get(c) == o]
        assert got[o]["size"] == len(mine) and got[o]["cohesion"] == pytest.approx(np.mean(mine), abs=2e-4) and got[o]["radius_p25"] == pytest.approx(np.percentile(mine, 25), abs=2e-4)


def test_rows_without_nests(spark):
    none = spark.createDataFrame([], "id long, v array<double>, cell int")
    few = spark.createDataFrame([(i, [1.0, 0.0], i) for i in range(5)] + [(9, None, 1), (10, [0.0, 0.0], 1)], "id long, v array<double>, cell int")
    for df in (none, few):
        members, shape = N.find_nests(df, id_col="id", vec_col="v", cell_col="cell")
        assert members.collect() == [] and shape.collect() == []
    one = few.withColumn("cell", F.lit(3))
    members, shape = N.find_nests(one, id_col="id", vec_col="v", cell_col="cell", least=5)
    assert {tuple(r) for r in members.collect()} == {(i, 3) for i in range(5)} and [tuple(r) for r in shape.collect()] == [(3, 5, 1.0, 1.0, 1)]


def test_random_is_stable():
    rng = random.Random(1)
    x = np.array([[rng.random() for _ in range(4)] for _ in range(30)])
    assert N.linked_groups(x, [1] * 30, 0.05) == N.linked_groups(x.copy(), [1] * 30, 0.05)
