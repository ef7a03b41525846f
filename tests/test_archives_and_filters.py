"""Works archives, funding calls, definitions, and typed filters."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from augury.operators import filters as L
from augury.sources import archives as A


def test_work_tables(spark, tmp_path):
    who = lambda name, *places: ({"display_name": name}, [(p, c) for p, c in places])
    rows = [
        ("https://w.example/W1", ("Topic",), [(2019, 3), (2021, 2), (2022, None)], [who(" Ann ", ("Lab A", "DE"), ("Lab B", None)), who("Bob", ("Lab A", "DE")), who(None, (" ", "FR"))]),
        ("W2", None, None, None), ("W3", None, [(2018, 0)], [who("", )]), (None, None, [(2021, 1)], None), ("W4", None, [(2018, 4)], [who("Cy", ("  ", "US"))]),
    ]
    spark.createDataFrame(rows, A.WORK).withColumn("more", F.lit("x" * 100)).write.parquet(f"{tmp_path}/works")
    works = spark.read.parquet(f"{tmp_path}/works")
    got = {k: sorted(map(tuple, df.collect())) for k, df in A.work_tables(works, authors=2).items()}
    assert got == {"people": [("W1", "Ann; Bob", "Lab A; Lab B"), ("W4", "Cy", None)], "lead": [("W1", "Topic", "Lab A", "DE")], "citations": [("W1", 2, 5), ("W4", 0, 4)]}
    plan = A.work_tables(works)["citations"]._jdf.queryExecution().executedPlan().toString()
    assert "more" not in plan.split("ReadSchema")[1] and "authorships" not in plan.split("ReadSchema")[1]


def test_funding_calls(spark):
    today = F.lit(dt.date(2024, 5, 1))
    eu = [
        (["HORIZON-1"], ["A <b>title</b>"], None, ["2024-06-30T17:00", "2024-04-01", None, "2025-01-01"], ["2024-02-01"], "Open", "What &amp; why", [1e6, 5e5]),
        (["X"], None, ["Call"], None, ["2030-01-01"], None, "", None), (["P-2"], ["late"], None, ["2024-04-30"], None, "open", None, None), (["P-3"], ["shut"], None, None, None, "Closed", None, None), ([], ["no id"], None, None, None, None, None, None),
    ]
    got = [tuple(r) for r in A.eu_calls(spark.createDataFrame(eu, A.EU_CALL), today, "u/{}").orderBy("url").collect()]
    assert got == [("u/HORIZON-1", "A title", "[Funding call · EU HORIZON · HORIZON-1 · open · deadline 2024-04-01, 2024-06-30, 2025-01-01 · €1.5M] What & why", dt.date(2024, 2, 1)), ("u/X", "Call", "[Funding call · EU · X] Call", dt.date(2024, 5, 1))]
    hits = [("1", "N-1", "Grant", "NSF", None, "posted", "01/31/2024", "Jun 30, 2024 12:00:00 AM EDT"), ("2", None, "Old", None, "DOE", None, None, "04/30/2024"), ("3", None, "Plain", None, "DOE", None, "junk", None), ("4", None, "", None, None, None, None, None)]
    got = [tuple(r) for r in A.us_calls(spark.createDataFrame(hits, A.US_HIT), spark.createDataFrame([("1", "40000", "none", "<p>Body</p>"), ("1", "40000", "none", "<p>Body</p>")], A.US_SYNOPSIS), today, "g/{}").orderBy("url").collect()]
    assert got == [("g/1", "Grant", "[Funding call · US NSF · N-1 · posted · deadline 2024-06-30 · up to $40k per award] Body", dt.date(2024, 1, 31)), ("g/3", "Plain", "[Funding call · US DOE]", None)]


def test_definitions(spark, tmp_path):
    good = {"b": {"name": "Beta", "phrases": ["x y"], "target_recall": 0.8}, "a": {"name": "Alpha", "classes": ["H01M"], "topics": ["T1"]}}
    (tmp_path / "d.json").write_text(json.dumps(good))
    rows = A.definitions(spark, str(tmp_path / "d.json")).collect()
    assert [(r["key"], r["name"], [tuple(s) for s in r["seeds"]], r["target_recall"]) for r in rows] == [("a", "Alpha", [("classes", "H01M"), ("topics", "T1")], 0.9), ("b", "Beta", [("phrases", "x y")], 0.8)]
    bad = {"a": {"classes": "H01M", "colour": 1}, "b": {"name": "B", "target_recall": 2}}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError) as e:
        A.definitions(spark, str(tmp_path / "bad.json"))
    assert str(e.value) == "a: classes has the wrong type; a: colour is not known; a: name is missing; b: no seeds; b: target_recall is not between 0 and 1"
    (tmp_path / "d.yaml").write_text("a:\n  name: Alpha\n  phrases: [x]\n")
    pytest.importorskip("yaml")
    assert A.definitions(spark, str(tmp_path / "d.yaml")).first()["name"] == "Alpha"


ALLOWED = L.Allowed(facets={"kind": ["News", "Paper"]}, sorts={"new": ["-day"], "best": ["-score", "day"]}, windows={"week": 7, "all": None}, default_sort="new", page_sizes={"grid": 2, "list": 3})


def test_filters_are_checked():
    f = L.parse({"kind": "paper,PAPER, other", "without": "s1,,s2", "least": "150", "window": "ever", "sort": "worst", "page": "0", "view": ["list"], "search": "  "}, ALLOWED)
    assert f == L.Filter({"kind": ("Paper",)}, ("s1", "s2"), 100, None, None, "new", 3, 0)
    assert L.parse({}, ALLOWED) == L.Filter({}, (), 0, None, None, "new", 2, 0)
    assert [L.whole(x, 1, 0, 100) for x in ("12abc", "-5", "+7", "x", "", "١٢", "-")] == [12, 0, 7, 1, 1, 1, 1]
    assert L.parse({"page": "3", "least": "7", "window": "week", "sort": "best"}, ALLOWED) == L.Filter({}, (), 7, 7, None, "best", 2, 4)


def test_filters_are_applied(spark):
    rows = [(i, ["News", "Paper", None][i % 3], f"s{i % 4}" if i % 5 else None, i % 11, i % 10, f"Title {i} of Things") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, kind string, source string, score int, day int, text string")
    f = L.parse({"kind": "news", "without": "s1", "least": "3", "window": "week", "search": "title OF", "sort": "best", "page": "2", "view": "list"}, ALLOWED)
    hits = df.where(L.predicate(f, {"kind": "kind"}, source="source", score="score", age_days=F.col("day"), text="text"))
    want = [r for r in rows if r[1] == "News" and r[2] != "s1" and r[3] >= 3 and r[4] < 7]
    assert {r["id"] for r in hits.collect()} == {r[0] for r in want}
    order = sorted(want, key=lambda r: (-r[3], r[4], -r[0]))
    assert [r["id"] for r in L.page(hits, f, ALLOWED, "id").collect()] == [r[0] for r in order[3:6]]
