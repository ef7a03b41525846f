"""Readers: files of many shapes into typed rows. Schemas are given, never inferred; bad rows are kept apart by
nulls, not by failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from augury.functions.text import strip_tags


def parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; quoted fields may hold line breaks."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, multiLine=True, escape='"', mode="PERMISSIVE")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, whole: bool = False) -> DataFrame:
    """One object a line, or (whole) one document a file."""
    return spark.read.json(path, schema=schema, multiLine=whole, mode="PERMISSIVE")


def json_pages(spark: SparkSession, path: str, items: str, item_schema: str) -> DataFrame:
    """Paged API answers: the objects in field ``items`` of each document."""
    raw = spark.read.text(path, wholetext=True)
    got = F.from_json("value", f"{items} array<{item_schema}>")
    return raw.select(F.explode_outer(got[items]).alias("item")).where("item is not null").select("item.*")


def xml(spark: SparkSession, path: str, row_tag: str, schema: StructType | str) -> DataFrame:
    """Sitemaps, Atom and RSS feeds, class definitions: one row for each ``row_tag``."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items: url, title, excerpt, published; rows without url or title go."""
    rows = xml(spark, path, "item", "title string, link string, description string, pubDate string")
    published = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"))
    return rows.select(F.trim("link").alias("url"), F.trim("title").alias("title"), strip_tags("description").alias("excerpt"), published.alias("published")).where("url is not null and title is not null and title <> ''")


def sitemap(spark: SparkSession, path: str, after: str, before: str) -> DataFrame:
    rows = xml(spark, path, "url", "loc string, lastmod string").select(F.trim("loc").alias("url"), F.to_date(F.substring("lastmod", 1, 10)).alias("day"))
    return rows.where(F.col("url").isNotNull() & F.col("day").between(F.lit(after).cast("date"), F.lit(before).cast("date")))


def repaired_url(url: Column | str, base: Column | str) -> Column:
    """Site-relative links get the feed's host; links without a usable host are null."""
    u, b = (F.trim(F.col(c)) if isinstance(c, str) else c for c in (url, base))
    host = F.regexp_extract(b, r"^(https?://[^/]+)", 1)
    full = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(host, u)).otherwise(u)
    return F.when(full.rlike(r"^https?://[^/\s]+\.[^/\s]+") & ~full.rlike("^https?://undefined"), full)


def inverted_text(index: Column) -> Column:
    """A map word -> positions back to text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def month_capped(df: DataFrame, ts: str, order: list[Column], cap: int) -> DataFrame:
    from augury.functions.dates import month_key
    from augury.operators.relational import first_per_key

    return first_per_key(df.withColumn("_month", month_key(ts)), ["_month"], order, cap).drop("_month")
