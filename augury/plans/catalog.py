"""The query catalogue: every query's Spark callable and, where SQL can express it, its ANSI twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _module in ("relational", "joins", "series", "scalars", "search", "resolution", "vectors", "monitoring", "rules", "predicates", "codes", "trends", "readmodels", "changes", "patents", "grounding", "themes", "pages"):
    importlib.import_module(f"augury.plans.{_module}")
