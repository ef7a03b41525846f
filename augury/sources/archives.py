"""Typed records of works archives and funding calls, and definitions that are checked when they are read."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions.abstracts import clean_text

WORK = """id string, primary_topic struct<display_name:string>, counts_by_year array<struct<year:int,cited_by_count:int>>,
authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string,country_code:string>>>>"""


def named(xs: Column) -> Column:
    """Trimmed names that say something."""
    return F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")


def work_tables(works: DataFrame, authors: int = 30, recent_from: int = 2020) -> dict[str, DataFrame]:
    """Flat tables of an archive of works (columns of ``WORK``, and only those are read): ``people`` (work_id, authors, institutions), ``lead`` (work_id, topic,
    institution, country of the first author's first institution) and ``citations`` (work_id, recent, total). The cap on authors is part of the tables: a page shows so
    many. Works without id, and works that would have an empty row, have none."""
    none = lambda kind: F.array().cast(kind)
    said = F.slice(F.coalesce("authorships", none("array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string,country_code:string>>>>")), 1, authors)
    w = works.withColumn("work_id", F.element_at(F.split("id", "/"), -1)).where("work_id <> ''").withColumn("some", said)
    people = named(F.transform("some", lambda a: a["author"]["display_name"]))
    places = F.array_distinct(named(F.flatten(F.transform("some", lambda a: F.coalesce(F.transform(a["institutions"], lambda i: i["display_name"]), none("array<string>"))))))
    text = lambda xs: F.nullif(F.array_join(xs, "; "), F.lit(""))
    flat = w.select("work_id", text(people).alias("authors"), text(F.slice(places, 1, authors)).alias("institutions")).where("authors IS NOT NULL OR institutions IS NOT NULL")
    first = F.get(F.get("some", F.lit(0))["institutions"], F.lit(0))
    lead = w.select("work_id", F.col("primary_topic.display_name").alias("topic"), F.nullif(F.trim(first["display_name"]), F.lit("")).alias("institution"), first["country_code"].alias("country")).where("institution IS NOT NULL")
    count = lambda keep: F.aggregate(F.filter("counts_by_year", keep), F.lit(0), lambda s, x: s + F.coalesce(x["cited_by_count"], F.lit(0)))
    cited = w.select("work_id", count(lambda x: x["year"] >= recent_from).alias("recent"), count(lambda x: F.lit(True)).alias("total")).where("total > 0")
    return {"people": flat, "lead": lead, "citations": cited}


def amount(value: Column, sign: str) -> Column:
    """A sum as it is read: 1500000 -> 1.5M, 40000 -> 40k; null for nothing."""
    v = value.try_cast("double")
    short = lambda by, unit: F.concat(F.regexp_replace(F.round(v / by, 1).cast("string"), r"\.0$", ""), F.lit(unit))
    return F.concat(F.lit(sign), F.when(v >= 1e6, short(1e6, "M")).when(v >= 1e3, short(1e3, "k")).when(v > 0, F.regexp_replace(v.cast("string"), r"\.0$", "")))


def call_text(parts: list[Column], body: Column) -> Column:
    """``[Funding call · part · part] body``, what is null left out, 2,000 characters at most."""
    head = F.concat(F.lit("["), F.concat_ws(" · ", F.lit("Funding call"), *(F.nullif(p, F.lit("")) for p in parts)), F.lit("]"))
    return F.substring(F.trim(F.concat_ws(" ", head, body)), 1, 2000)


def not_after(day: Column, last: Column) -> Column:
    """The day, the last one at most; null stays."""
    return F.when(day.isNotNull(), F.least(day, last))


EU_CALL = """identifier array<string>, title array<string>, callTitle array<string>, deadlineDate array<string>, startDate array<string>, status string, description string,
budgets array<double>"""


def eu_calls(calls: DataFrame, today: Column, url: str = "https://calls.example/topic/{}") -> DataFrame:
    """``url, title, excerpt, published`` of European calls (columns of ``EU_CALL``): those without identifier or title, closed ones, and those whose last deadline has passed go."""
    ident, title = F.get("identifier", F.lit(0)), clean_text(F.coalesce(F.get("title", F.lit(0)), F.get("callTitle", F.lit(0))))
    days = F.array_sort(F.array_distinct(F.transform(F.filter("deadlineDate", lambda d: d.isNotNull()), lambda d: F.substring(d, 1, 10))))
    told = calls.select(ident.alias("ident"), title.alias("title"), F.coalesce(days, F.array().cast("array<string>")).alias("days"), F.lower("status").alias("status"), F.get("startDate", F.lit(0)).alias("opened"),
                        clean_text(F.coalesce(F.nullif("description", F.lit("")), F.get("callTitle", F.lit(0)))).alias("body"), F.aggregate(F.coalesce("budgets", F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).alias("budget"))
    last = F.try_element_at("days", F.lit(-1))
    open_ = told.where((F.col("ident") != "") & (F.col("title") != "") & (F.coalesce("status", F.lit("")) != "closed") & F.coalesce(last >= F.date_format(today, "yyyy-MM-dd"), F.lit(True)))
    programme = F.when(F.col("ident").contains("-"), F.concat(F.lit("EU "), F.split_part("ident", F.lit("-"), F.lit(1)))).otherwise("EU")
    due = F.when(F.size("days") > 0, F.concat(F.lit("deadline "), F.array_join(F.slice("days", F.greatest(F.size("days") - 2, F.lit(1)), F.lit(3)), ", ")))
    return open_.select(F.replace(F.lit(url), F.lit("{}"), F.col("ident")).alias("url"), "title", call_text([programme, F.col("ident"), F.col("status"), due, amount(F.col("budget"), "€")], F.col("body")).alias("excerpt"),
                        not_after(F.substring("opened", 1, 10).try_cast("date"), today).alias("published"))


US_HIT = "id string, number string, title string, agency string, agencyCode string, oppStatus string, openDate string, closeDate string"
US_SYNOPSIS = "id string, awardCeiling string, estimatedFunding string, synopsisDesc string"


def us_date(said: Column) -> Column:
    """01/31/2024, or Jan 31, 2024 with or without a time behind it."""
    return F.coalesce(F.try_to_timestamp(said, F.lit("MM/dd/yyyy")), F.try_to_timestamp(F.regexp_extract(said, r"^([A-Z][a-z]{2} [0-9]{2}, [0-9]{4})", 1), F.lit("MMM dd, yyyy"))).cast("date")


def us_calls(hits: DataFrame, synopses: DataFrame, today: Column, url: str = "https://grants.example/detail/{}") -> DataFrame:
    """``url, title, excerpt, published`` of American calls (``US_HIT``) with their synopses (``US_SYNOPSIS``), where there is one; past ones go. Contacts are not taken over."""
    h = hits.join(synopses.dropDuplicates(["id"]), "id", "left").withColumns({"title": clean_text("title"), "due": us_date(F.col("closeDate")), "opened": us_date(F.col("openDate"))})
    h = h.where((F.col("id") != "") & (F.col("title") != "") & F.coalesce(F.col("due") >= today, F.lit(True)))
    behind = lambda words, c, more="": F.when(c.isNotNull(), F.concat(F.lit(words), c, F.lit(more)))
    parts = [F.concat_ws(" ", F.lit("US"), F.coalesce("agency", "agencyCode")), F.col("number"), F.col("oppStatus"), behind("deadline ", F.col("due").cast("string")), behind("up to ", amount(F.col("awardCeiling"), "$"), " per award"), behind("total ", amount(F.col("estimatedFunding"), "$"))]
    return h.select(F.replace(F.lit(url), F.lit("{}"), F.col("id")).alias("url"), "title", call_text(parts, clean_text("synopsisDesc")).alias("excerpt"), not_after(F.col("opened"), today).alias("published"))


#: What a definition of a domain holds: name, whether it must, and of which type.
DOMAIN = {"name": (True, str), "classes": (False, list), "topics": (False, list), "phrases": (False, list), "anchors": (False, list), "target_recall": (False, (int, float))}
SEEDS = ("classes", "topics", "phrases", "anchors")


def definitions(spark: SparkSession, path: str, rules: Mapping[str, tuple[bool, type | tuple[type, ...]]] = DOMAIN) -> DataFrame:
    """``key, name, seeds, target_recall`` of a definitions file, JSON or (with PyYAML) YAML, read by Spark from wherever it is. A file is checked as a whole: every fault of every
    definition is named in one error. Settings of people's making: one small file."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        told = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        told = yaml.safe_load(text)
    if not isinstance(told, dict) or not all(isinstance(v, dict) for v in told.values()):
        raise ValueError("a definitions file maps keys to definitions")
    faults = [f"{k}: {n} is missing" for k, v in told.items() for n, (must, _) in rules.items() if must and not v.get(n)]
    faults += [f"{k}: {n} is not known" for k, v in told.items() for n in v if n not in rules]
    faults += [f"{k}: {n} has the wrong type" for k, v in told.items() for n, x in v.items() if n in rules and x is not None and (not isinstance(x, rules[n][1]) or isinstance(x, bool))]
    faults += [f"{k}: no seeds" for k, v in told.items() if not any(v.get(s) for s in SEEDS)]
    faults += [f"{k}: target_recall is not between 0 and 1" for k, v in told.items() if isinstance(v.get("target_recall", 0.5), (int, float)) and not 0 < v.get("target_recall", 0.5) < 1]
    if faults:
        raise ValueError("; ".join(sorted(faults)))
    rows = [(k, v["name"], [(s, str(x)) for s in SEEDS for x in v.get(s) or []], float(v.get("target_recall", 0.9))) for k, v in sorted(told.items())]
    return spark.createDataFrame(rows, "key string, name string, seeds array<struct<kind:string,seed:string>>, target_recall double")
