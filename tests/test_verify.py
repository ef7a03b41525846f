"""Verdicts on numbers and references."""

import random

from pyspark.sql import functions as F

from augury.operators import verify as V


def test_numbers_of_texts(spark):
    df = spark.createDataFrame([(1, "In 2019 5 of 120 (12.5 %) cost 3.50, 120 again; 45%."), (2, None), (3, "none")], "id long, t string")
    assert {tuple(r) for r in V.numbers(df, "id", F.col("t")).collect()} == {(1, "plain", 120.0), (1, "percent", 12.5), (1, "plain", 3.5), (1, "percent", 45.0)}


def test_numbers_against_all_evidence(spark):
    rng = random.Random(2)
    claims = [(i, rng.choice(["plain", "percent"]), round(rng.choice([0.0, rng.uniform(0, 3), rng.uniform(10, 1e6)]), 2)) for i in range(200)]
    held = [(u, round(v * rng.choice([1, 1.004, 0.992, 1.03]), 2)) for _, u, v in rng.sample(claims, 90)] + [("other", 5.0)]
    got = V.check_numbers(spark.createDataFrame(claims, "id long, unit string, value double"), spark.createDataFrame(held, "unit string, value double"))
    for r in got.collect():
        far = min((abs(v - r["value"]) for u, v in held if u == r["unit"] and abs(v - r["value"]) <= max(v, r["value"]) * 0.01), default=None)
        assert r["verdict"] == ("none" if far is None else "exact" if far == 0 else "rounded") and (far is None) == (r["nearest"] is None)
        assert far is None or abs(r["nearest"] - r["value"]) == far
    assert got.count() == 200


def test_references(spark):
    text = "We use 10.5555/a1 on growing mosses in cities, 32016R0679, EP-2345678-B1 and EP-9999999-A1."
    refs = V.references(spark.createDataFrame([(1, text)], "id long, t string"), "id", F.col("t"))
    assert {(r["kind"], r["ref"]) for r in refs.collect()} == {("work", "10.5555/a1"), ("law", "32016R0679"), ("patent", "EP-2345678-B1"), ("patent", "EP-9999999-A1")}
    known = [("work", "10.5555/a1", "Mosses growing in cities"), ("law", "32016R0679", "Something else entirely, of other matters"), ("patent", "EP-2345678-A2", None)]
    got = V.check_references(refs.withColumn("line", F.lit(text)), spark.createDataFrame(known, "kind string, ref string, title string"))
    assert {(r["ref"], r["verdict"]) for r in got.collect()} == {("10.5555/a1", "found"), ("32016R0679", "other_title"), ("EP-2345678-B1", "found"), ("EP-9999999-A1", "unknown")}


def test_windows_widen(spark):
    from augury.operators import monitoring as M

    rows = [("a", d, 1.0) for d in (1, 2, 3)] + [("b", d, 2.0) for d in (1, 40, 41, 400)] + [("c", 500, 1.0), ("c", -1, 9.0), ("d", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, age int, v double")
    got = {r["k"]: tuple(r)[1:] for r in M.narrowest_window(df, ["k"], F.col("age"), [10, 50, 450], 3, F.col("v")).collect()}
    assert got == {"a": (10, 3, 3.0, True), "b": (50, 3, 6.0, True), "c": (450, 0, None, False), "d": (450, 0, None, False)}
