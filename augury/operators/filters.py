"""Typed filters from a page's parameters: what a list of pages may be asked for, checked against what is allowed, and applied to a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Raw = Mapping[str, str | Sequence[str] | None]


@dataclass(frozen=True)
class Allowed:
    """Facets and their values, sort orders, and windows in days by name."""

    facets: Mapping[str, Sequence[str]]
    sorts: Mapping[str, Sequence[str]]
    windows: Mapping[str, int | None]
    default_sort: str
    page_sizes: Mapping[str, int] = field(default_factory=lambda: {"grid": 24, "list": 50})


@dataclass(frozen=True)
class Filter:
    facets: Mapping[str, tuple[str, ...]]
    without: tuple[str, ...]
    least: int
    window: int | None
    search: str | None
    sort: str
    limit: int
    offset: int


def one(raw: Raw, name: str) -> str:
    said = raw.get(name)
    said = said if isinstance(said, str) or said is None else next(iter(said), "")
    return (said or "").strip()


def whole(said: str, default: int, low: int, high: int | None = None) -> int:
    """The number that a text begins with, within bounds; the default where it begins with none."""
    digits = said[1:] if said[:1] in "+-" and said else said
    n = 0
    while n < len(digits) and digits[n].isascii() and digits[n].isdigit():
        n += 1
    value = int(said[: len(said) - len(digits)] + digits[:n]) if n else default
    return max(low, value if high is None else min(high, value))


def parse(raw: Raw, allowed: Allowed) -> Filter:
    """Names outside the allowed ones are dropped, never an error; facets match in any case and keep the allowed spelling."""
    listed = lambda name: [x.strip() for x in one(raw, name).split(",") if x.strip()]
    facets = {}
    for name, values in allowed.facets.items():
        spelling = {v.lower(): v for v in values}
        found = tuple(dict.fromkeys(spelling[x.lower()] for x in listed(name) if x.lower() in spelling))
        if found:
            facets[name] = found
    view = one(raw, "view") if one(raw, "view") in allowed.page_sizes else next(iter(allowed.page_sizes))
    size = allowed.page_sizes[view]
    sort = one(raw, "sort")
    return Filter(facets, tuple(listed("without")), whole(one(raw, "least"), 0, 0, 100), allowed.windows.get(one(raw, "window")), one(raw, "search") or None,
                  sort if sort in allowed.sorts else allowed.default_sort, size, (whole(one(raw, "page"), 1, 1) - 1) * size)


def predicate(f: Filter, columns: Mapping[str, str], *, source: str, score: str, age_days: Column, text: str) -> Column:
    """The condition of a filter; columns names the column of each facet."""
    keep = F.lit(True)
    for name, values in f.facets.items():
        keep = keep & F.col(columns[name]).isin(*values)
    if f.without:
        keep = keep & ~F.coalesce(F.col(source), F.lit("")).isin(*f.without)
    if f.least:
        keep = keep & (F.col(score) >= f.least)
    if f.window is not None:
        keep = keep & (age_days < f.window)
    for word in (f.search or "").lower().split():
        keep = keep & F.lower(text).contains(word)
    return F.coalesce(keep, F.lit(False))


def page(df: DataFrame, f: Filter, allowed: Allowed, id_col: str) -> DataFrame:
    """The page's rows in total order: ``-column`` sorts down, nulls last, the id ends every order."""
    order = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in allowed.sorts[f.sort]]
    return df.orderBy(*order, F.desc(id_col)).offset(f.offset).limit(f.limit)
