"""Verification of what texts claim: numbers and references, held against tables of evidence, one verdict a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions import references as R

NUMBER = r"([0-9]+(?:[.][0-9]+)?)( ?%)?"
#: Verdicts on numbers from the best to none.
VERDICTS = ("exact", "rounded", "none")


def numbers(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``id_col, unit, value`` of the distinct numbers of texts: percentages apart from plain ones; years, and whole numbers under ten, claim nothing."""
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(i)).alias(n) for i, n in ((1, "v"), (2, "p"))))
    told = F.transform(parts, lambda p: F.struct(F.when(p["p"] != "", "percent").otherwise("plain").alias("unit"), p["v"].cast("double").alias("value")))
    idle = lambda x: (x["unit"] == "plain") & (x["value"] % 1 == 0) & ((x["value"] < 10) | x["value"].between(1900, 2100))
    return df.select(id_col, F.inline(F.array_distinct(F.filter(told, lambda x: ~idle(x)))))


def check_numbers(claims: DataFrame, evidence: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """claims (any columns, with ``unit, value``) with ``verdict`` and ``nearest``: exact, within the tolerance of the larger of both, or none. evidence:
    ``unit, value``. Values meet in blocks of that relative width, each in its own and its neighbours; evidence is taken distinct, and so
    are the claims' values before the join, so that a number which all texts repeat is looked up once."""
    wide = F.log(F.lit(1 + tolerance))
    block = lambda v: F.when(v > 0, F.floor(F.log(v) / wide)).cast("long")
    asked = claims.select("unit", "value").distinct().withColumn("b", F.coalesce(block(F.col("value")), F.lit(-(1 << 40))))
    held = evidence.select("unit", F.col("value").alias("held")).distinct().withColumn("at", F.coalesce(block(F.col("held")), F.lit(-(1 << 40))))
    held = held.select("unit", "held", F.explode(F.array(*(F.col("at") + i for i in (-2, -1, 0, 1, 2)))).alias("b"))
    far = F.abs(F.col("value") - F.col("held"))
    near = asked.join(held, ["unit", "b"]).where(far <= F.greatest("value", "held") * tolerance)
    best = near.groupBy("unit", "value").agg(F.min(F.struct(far.alias("far"), "held")).alias("x"))
    verdicts = asked.join(best, ["unit", "value"], "left").select("unit", "value", F.when(F.col("x").isNull(), "none").when(F.col("x.far") == 0, "exact").otherwise("rounded").alias("verdict"), F.col("x.held").alias("nearest"))
    return claims.join(verdicts, ["unit", "value"])


def references(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``id_col, kind, ref`` of the works, laws and patents that texts name."""
    kinds = {"work": R.works_in(text), "law": R.laws_in(text), "patent": R.patents_in(text)}
    named = lambda kind, found: F.transform(found, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))
    every = F.flatten(F.array(*(named(kind, found) for kind, found in kinds.items())))
    return df.select(id_col, F.inline(every))


def check_references(claims: DataFrame, known: DataFrame, least: float = 0.4) -> DataFrame:
    """claims: ``kind, ref, line`` and more, line being what the text says beside the reference. known: ``kind, ref, title``. Verdicts: found, other_title (fewer than ``least`` of
    the title's content words stand in the line), or unknown. A patent is found without its kind letter too."""
    base = lambda c: F.when((F.col("kind") == "patent") & (F.size(F.split(c, "-")) == 3), F.substring_index(c, "-", 2)).otherwise(c)
    content = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    held = known.select("kind", base(F.col("ref")).alias("_base"), "title").groupBy("kind", "_base").agg(F.max("title").alias("title"))
    joined = claims.withColumn("_base", base(F.col("ref"))).join(held.withColumn("_known", F.lit(True)), ["kind", "_base"], "left")
    share = F.size(F.array_intersect(content(F.col("title")), content(F.col("line")))) / F.size(content(F.col("title")))
    verdict = F.when(F.col("_known").isNull(), "unknown").when((F.size(content(F.col("title"))) == 0) | (share >= least), "found").otherwise("other_title")
    return joined.withColumn("verdict", verdict).drop("_base", "_known")
