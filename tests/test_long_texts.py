"""How long cleaning and looking for references take, and references in odd places."""

import re
import time

import pytest
from pyspark.sql import functions as F

from augury.functions import abstracts as A
from augury.functions import references as R


def seconds(spark, said, f):
    df = spark.createDataFrame([(said,)] * 4, "x string").coalesce(1).cache()
    df.count()
    took = []
    for _ in range(3):
        start = time.perf_counter()
        df.agg(F.max(F.xxhash64(f(F.col("x"))))).collect()
        took.append(time.perf_counter() - start)
    df.unpersist()
    return min(took)


@pytest.mark.parametrize("f, times", [(A.clean_text, 12), (lambda x: F.concat(R.works_in(x), R.laws_in(x), R.patents_in(x)), 2.3)])
def test_a_text_is_worked_through_a_few_times_only(spark, f, times):
    """Against one replacement of every gap between words."""
    said = "Größere Worte von schlichter Prosa stehen hier, und keines von ihnen nennt ein Ding. " * 10000
    plain = seconds(spark, said, lambda x: F.regexp_replace(x, "[^a-z0-9]+", "-"))
    assert seconds(spark, said, f) < times * plain


def test_references_in_odd_places(spark):
    said = ["10.10.1234/ab", "(10.5555/x|10.5555/y)", "EP1234567-89", "WO2021/034567-1999", "XEP1234567"]
    row = spark.range(1).select(*(F.to_json(F.struct(f(F.lit(x)).alias("v"))) for x in said for f in (R.works_in, R.patents_in))).first()
    got = [re.sub('.*\\[|\\].*|"', "", x).replace("\\", "") for x in row]
    assert got == ["10.1234/ab", "", "10.5555/x,10.5555/y", "", "", "EP-1234567", "", "WO-2021034567", "", ""]


def test_days_beside_letters_of_any_script(spark, tmp_path):
    from augury.plans.catalog import QUERIES

    spark.createDataFrame([(1, "é2020-01-02 x1999-12-31 2001-02-03.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["references_in_text"](spark, str(tmp_path)).first()["days"] == "2001-02-03|2020-01-02"
