"""Stored heads: scores by SQL from the stored tables, thresholds from their own part, per tier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import heads as H

DIMS = 6


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, DIMS))
    rows = [(i, (centres[i % 4] + 0.9 * rng.normal(size=DIMS)).tolist(), ["a", "b", None][i % 3], i % 4) for i in range(600)]
    rows += [(1000, [0.0] * DIMS, "a", 1), (1001, None, "a", 1), (None, [1.0] * DIMS, "a", 1), (1003, [1.0] * DIMS, "new", None)]
    return spark.createDataFrame(rows, "vid long, emb array<double>, kind string, label int").repartition(3)


def rows_of(table, **targets):
    return H.directed(table, id_col="vid", vec_col="emb", tier=F.col("kind"), **targets)


@pytest.fixture(scope="module")
def trained(table):
    rows = rows_of(table, theme=F.col("label").cast("string"), low=(F.col("label") < 2).cast("int").cast("string"))
    return rows, H.train(rows, ["theme", "low"], accuracy=0.8)


def test_scores_by_sql_from_the_stored_tables(spark, trained, table, tmp_path):
    import duckdb

    rows, heads = trained
    heads.save(str(tmp_path))
    table.write.parquet(f"{tmp_path}/rows")
    again = H.Heads.load(spark, str(tmp_path))
    got = {(r["id"], r["head"]): r for r in again.answers(rows).collect()}
    con = duckdb.connect()
    for n in ("rows", "weights", "means", "thresholds"):
        con.execute(f"create view {n} as select * from '{tmp_path}/{n}/*.parquet'")
    said = con.execute("""
        WITH r AS (SELECT vid, coalesce(kind, 'none') AS tier, list_transform(emb, lambda x: x / sqrt(list_sum(list_transform(emb, lambda y: y * y)))) AS v FROM rows WHERE vid IS NOT NULL AND list_sum(list_transform(emb, lambda y: y * y)) > 0),
        c AS (SELECT vid, list_transform(range(1, len(v) + 1), lambda i: v[i] - coalesce(m.mean, w.mean)[i]) AS d FROM r LEFT JOIN means m ON m.tier = r.tier, (SELECT mean FROM means WHERE tier IS NULL) w),
        f AS (SELECT vid, list_transform(d, lambda x: x / sqrt(list_sum(list_transform(d, lambda y: y * y)))) AS f FROM c),
        e AS (SELECT vid, head, class, exp(intercept + list_dot_product(weights, f)) AS e FROM f, weights),
        p AS (SELECT vid, head, class, e / sum(e) OVER (PARTITION BY vid, head) AS p FROM e),
        o AS (SELECT *, row_number() OVER (PARTITION BY vid, head ORDER BY round(p, 9) DESC, class) AS i FROM p)
        SELECT o.vid, o.head, CASE WHEN max(p) FILTER (i = 1) >= any_value(t.threshold) THEN any_value(class) FILTER (i = 1) END, any_value(class) FILTER (i = 2), max(p) FILTER (i = 1) FROM o JOIN thresholds t ON t.head = o.head GROUP BY ALL""").fetchall()
    assert len(said) == len(got) == 2 * 601 and {h for _, h in got} == {"theme", "low"}
    for vid, head, answer, second, p in said:
        r = got[vid, head]
        assert (r["answer"], r["second"]) == (answer, second) and r["confidence"] == pytest.approx(p, abs=1e-8)


def test_heads_learn_and_abstain(trained):
    rows, heads = trained
    truth = {(r["id"], r["head"]): r["y"] for r in H.truths(rows, ["theme", "low"]).collect()}
    judged = [r for r in heads.answers(rows).where("part = 'judge'").collect() if (r["id"], r["head"]) in truth]
    for head in ("theme", "low"):
        mine = [r for r in judged if r["head"] == head]
        answered = [r for r in mine if r["answer"]]
        right = sum(r["answer"] == truth[r["id"], head] for r in answered) / len(answered)
        assert right > 0.7 and len(answered) > len(mine) / 3
    assert any(r["answer"] is None for r in judged)


def test_thresholds_come_from_their_own_part(table, trained):
    rows, heads = trained
    turned = lambda of: F.when(H.part(F.col("vid")) == of, (F.col("label") + 1) % 4).otherwise(F.col("label")).cast("string")
    weights = lambda h: sorted((r["class"], [round(x, 6) for x in (r["intercept"], *r["weights"])]) for r in h.weights.where("head = 'theme'").collect())
    want = {r["head"]: r["threshold"] for r in heads.thresholds.collect()}
    judge = H.train(rows_of(table, theme=turned("judge")), ["theme"], accuracy=0.8)
    assert judge.thresholds.collect()[0]["threshold"] == want["theme"] and weights(judge) == weights(heads)
    other = H.train(rows_of(table, theme=turned("set")), ["theme"], accuracy=0.8)
    assert other.thresholds.collect()[0]["threshold"] == H.STRICT  # nothing reaches the accuracy on labels that are all wrong
    shares = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["fit"] / 601 - 0.6) < 0.06 and abs(shares["set"] / 601 - 0.2) < 0.06


def test_thresholds_of_tiers(table):
    rows = rows_of(table, probe=(F.col("label") == 3).cast("int").cast("string"))
    heads = H.train(rows, ["probe"], recall=0.8)
    truth = {r["id"]: r["y"] for r in H.truths(rows, ["probe"]).collect()}
    every = [r for r in heads.members(rows).collect() if r["id"] in truth]
    at = {r["tier"]: r["threshold"] for r in heads.thresholds.collect()}
    assert set(at) == {"a", "b", "none", None}
    for tier in at:
        told = [np.floor(r["p"] * 1e4) / 1e4 for r in every if r["part"] == "set" and truth[r["id"]] == "1" and tier in (None, r["tier"])]
        assert at[tier] == pytest.approx(np.quantile(told, 0.2), abs=1e-9)
    assert all(r["member"] == (r["p"] >= at[r["tier"]]) for r in every)
    assert [r["member"] is not None for r in heads.members(rows).where("id = 1003").collect()] == [True]  # a tier never seen


def test_precision_at_prevalence(table):
    rows = rows_of(table, probe=(F.col("label") == 3).cast("int").cast("string"))
    heads = H.train(rows, ["probe"], recall=0.8)
    scored, truth = heads.score(rows), H.truths(rows, ["probe"])
    y = {r["id"]: r["y"] == "1" for r in truth.collect()}
    p = {r["id"]: np.floor(r["p"] * 1e4) / 1e4 for r in heads.members(rows).where("part = 'set'").collect() if r["id"] in y}
    pos, neg = (np.array([v for i, v in p.items() if y[i] == k]) for k in (True, False))
    for share, target in ((0.25, 0.8), (0.01, 0.5), (0.0, 0.99), (0.9, 0.3)):
        pi = min(max(share, 1e-4), 0.5)
        ok = [t for t in sorted(set(p.values())) if (pos >= t).mean() * pi and (pos >= t).mean() * pi / ((pos >= t).mean() * pi + (neg >= t).mean() * (1 - pi)) >= target]
        assert H.precision_threshold(scored, truth, target, share).first()["threshold"] == pytest.approx(ok[0] if ok else H.STRICT)


def test_one_class_is_no_head(table):
    rows = rows_of(table, only=F.lit("x"))
    with pytest.raises(ValueError):
        H.train(rows, ["only"], accuracy=0.5)


def test_registered_probe_against_plain_counts(spark):
    """domain_probe's figures from the members that the same heads name."""
    from augury.plans import catalog
    from augury.plans.themes import probe_rows

    sf = "/root/testdata/sf0.001"
    rows = probe_rows(spark, sf)
    told = H.train(rows, ["probe"], recall=0.8).members(rows).collect()
    y = {r["id"]: r["probe"] == "1" for r in rows.collect()}
    got = {r["tier"]: r for r in catalog.QUERIES["domain_probe"](spark, sf).collect()}
    assert set(got) == {"0", "1"}
    for tier, r in got.items():
        mine = [m for m in told if m["tier"] == tier and m["part"] == "judge"]
        pos, neg = ([m["member"] for m in mine if y[m["id"]] == k] for k in (True, False))
        share = np.mean([y[m["id"]] for m in told if m["tier"] == tier])
        assert (r["judged"], r["positives"]) == (len(mine), len(pos))
        assert r["recall"] == pytest.approx(np.mean(pos), abs=0.02) and r["false_positive_rate"] == pytest.approx(np.mean(neg), abs=0.02)
        assert r["precision_at_prevalence"] == pytest.approx(r["recall"] * share / (r["recall"] * share + r["false_positive_rate"] * (1 - share)), abs=0.02)
