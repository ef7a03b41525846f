"""Pairs of rows are told where lists of ids meet; groups of vectors in tiles."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import resolve as V
from augury.plans import catalog

DIR = "/root/testdata/sf0.001"


def above_pairs(spark, name):
    """The plan above the last step that makes rows out of lists."""
    plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    return plan[:plan.index("Generate")]


def test_links_are_never_shuffled(spark):
    assert "Exchange" not in above_pairs(spark, "confirmed_links") and "Join" not in above_pairs(spark, "confirmed_links")


@pytest.mark.parametrize("name", ["prefix_theta_join", "trigram_jaccard", "fuzzy_title_dup"])
def test_pairs_of_rows_are_never_shuffled(spark, name):
    assert "Exchange" not in above_pairs(spark, name) and "Join" not in above_pairs(spark, name)


def test_pairs_of_a_year_are_counted_where_they_are_made(spark):
    assert "Join" not in above_pairs(spark, "pair_year_counts")


def test_rows_of_pairs(spark):
    """Lists shorter than a name's rows, repeated and null ids, null names and blocks."""
    rows = [(i, "xy"[i % 2], "ab"[i % 3 % 2]) for i in range(40)] + [(3, "y", "a"), (None, "x", "a"), (90, None, "a"), (91, "x", None)]
    df = spark.createDataFrame(rows, "id long, k string, name string")
    pairs = [("a", "b", 0.5), ("a", "a", 1.0)]
    got = V.rows_of_pairs(spark.createDataFrame(pairs, "na string, nb string, sim double"), df, "id", "name", ["k"], most=4).select("a", "b", "sim").collect()
    want = [(a, b, s) for a, k, n in rows for b, q, m in rows for x, y, s in pairs if None not in (a, b, k, q) and k == q and (n, m) == (x, y)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_every_name_begins_with_an_empty_one(spark, tmp_path):
    spark.createDataFrame([(1, "", "t"), (2, "ab", "t"), (3, "abc", "t"), (4, "ab", "u"), (5, "", "t")], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, catalog.QUERIES["prefix_theta_join"](spark, str(tmp_path)).collect()))
    assert got == [(1, 5), (2, 1), (2, 5), (3, 1), (3, 2), (3, 5), (5, 1)]


@pytest.mark.parametrize("size", [7, None])
def test_cosine_pairs_of_a_group(spark, size):
    x = np.random.default_rng(8).normal(size=(60, 4))
    rows = [(i, [None, 1, 2][i % 3], v.tolist()) for i, v in enumerate(x)] + [(100, 1, [0.0] * 4), (101, 1, None), (102, 2, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 and i % 3 == j % 3 and n[i] @ n[j] >= 0.4]
    assert sorted(map(tuple, V.cosine_pairs(df, "vec_id", "embedding", 0.4, size, group="label").collect())) == want


def stages_of_lists(df):
    """The stages of generated code that make rows out of lists, and the longest run of rows that share their first column."""
    longest = df.rdd.mapPartitions(lambda rows: [max((sum(1 for _ in g) for _, g in itertools.groupby(rows, key=lambda r: r[0])), default=0)]).max()
    df.collect()
    return re.findall(r"(\*\(\d+\) )?Generate explode\((_ids_a|_ids_b|buyers|sellers)\b", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]), longest


def test_pairs_of_two_lists_are_never_held_at_once(spark):
    """A stage of generated code keeps all rows that it makes of one row: lists of a thousand ids each would be a million pairs."""
    df = spark.range(900).select(F.col("id"), F.lit("x").alias("k"), F.lit("n").alias("name"))
    pairs = V.rows_of_pairs(spark.createDataFrame([("n", "n")], "na string, nb string"), df, "id", "name", ["k"], keep=lambda a, b: a != b).select("a", "b")
    stages, longest = stages_of_lists(pairs)
    assert len(stages) == 2 and stages[0][0] != stages[1][0]
    assert longest <= 128 and pairs.distinct().count() == pairs.count() == 900 * 899


def test_links_are_told_in_runs(spark, tmp_path):
    """Null, repeated and unknown keys, against the SQL; more suppliers of a nation than a run has."""
    import duckdb

    tables = {
        "customer": ("c_custkey long, c_nationkey int", [(i, i % 3) for i in range(40)] + [(None, 1), (90, None), (7, 1), (8, 0)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(i, i % 2) for i in range(700)] + [(None, 1), (800, None), (5, 1), (6, 1), (701, 5)]),
        "orders": ("o_orderkey long, o_custkey long", [(i, i % 45) for i in range(300)] + [(None, 1), (400, None), (299, 8)]),
        "lineitem": ("l_orderkey long, l_suppkey long", [(i % 310, i * 7 % 720) for i in range(2000)] + [(None, 1), (3, None)]),
    }
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    df = catalog.QUERIES["confirmed_links"](spark, str(tmp_path))
    stages, longest = stages_of_lists(df)
    assert len(stages) == 2 and stages[0][0] != stages[1][0] and longest <= 2 * 128  # a repeated buyer's
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got, want = sorted(map(tuple, df.collect()), key=order), sorted(con.execute(catalog.SQL["confirmed_links"]).fetchall(), key=order)
    assert got == want and {r[2] for r in got} == {0.5, 0.9}
