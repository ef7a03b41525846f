"""Calendar expressions: text months, integer months, ISO weeks, quarters, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(ts: Column | str) -> Column:
    """2024-03"""
    return F.date_format(col(ts), "yyyy-MM")


def month_int(ts: Column | str) -> Column:
    """Months since year 0: differences of these are whole months."""
    return (F.year(col(ts)) * 12 + F.month(col(ts)) - 1).cast("long")


def month_label(m: Column | str) -> Column:
    """The text month of an integer month."""
    m = col(m)
    return F.format_string("%04d-%02d", F.floor(m / 12), F.pmod(m, F.lit(12)) + 1)


def month_start(m: Column | str) -> Column:
    m = col(m)
    return F.make_date(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1))


def week_start(ts: Column | str) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", col(ts)).cast("date")


def iso_week(ts: Column | str) -> Column:
    """2024-W05"""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), col(ts)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(col(ts)).cast("string"), 2, "0"))


def quarter_key(ts: Column | str) -> Column:
    return F.concat(F.year(col(ts)).cast("string"), F.lit("-Q"), F.quarter(col(ts)).cast("string"))


def quarter_start_back(ts: Column | str, years: int) -> Column:
    return F.add_months(F.date_trunc("quarter", col(ts)).cast("date"), -12 * years)


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_timestamp(col(ts).cast("timestamp"))


def epoch_bucket(ts: Column | str, seconds: int) -> Column:
    e = epoch_seconds(ts)
    return e - F.pmod(e, F.lit(seconds))


def sort_date(published: Column | str, created: Column | str) -> Column:
    """A publication date never lies behind the time it was read at."""
    return F.least(F.coalesce(col(published), col(created)), col(created))
