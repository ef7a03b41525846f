"""References in texts: works, laws, patents. Each is found by its parts and then held against the rules of its kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import col

# Offices that grant patents, and letters of their documents' kinds.
OFFICES = ("EP", "US", "WO", "CN", "JP", "KR", "DE", "GB", "FR")
KIND_LETTERS = "ABCUYTE"
# Where data and software are kept, in addresses and in identifiers of works.
REPOSITORIES = ("zenodo.org", "10.5281/", "figshare", "dryad", "osf.io", "github.com", "gitlab.com", "softwareheritage", "dataverse", "10.7910/dvn")


def in_repository(url: Column | str) -> Column:
    """Whether an address leads to data or software; false for null."""
    low = F.lower(F.coalesce(col(url), F.lit("")))
    return reduce(lambda a, b: a | b, (low.contains(r) for r in REPOSITORIES))


def works_in(c: Column | str) -> Column:
    """Identifiers of works, ``10.<registrant>/<suffix>``, distinct, in order: registrants have four to nine digits. Marks
    and blanks end a suffix."""
    found = F.regexp_extract_all(col(c), F.lit(r"10[.][0-9]{4,9}/[^\s\"'<>)\]|,;]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: F.rtrim(w, F.lit("."))))


def laws_in(c: Column | str) -> Column:
    """Numbers of European legal acts: sector 3, a year, one or two letters, four figures."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit("3(?<![A-Za-z0-9_]3)[0-9]{4}[A-Z]{1,2}[0-9]{4}(?![A-Za-z0-9_])"), F.lit(0)))


def patents_in(c: Column | str) -> Column:
    """Publication numbers as ``office-number-kind``, distinct, in order. A number has six to nine figures, or a year and
    a serial of five or six, with a mark between them or none."""
    initials = "".join(sorted({o[0] for o in OFFICES}))  # looked at first, as few places of a text have one
    number = "(?:19|20)[0-9]{2}[/-]?[0-9]{5,6}|[0-9]{6,9}"
    shape = rf"({'|'.join(OFFICES)})[ -]?({number})(?:[ -]?([{KIND_LETTERS}][0-9]?))?"
    found = F.regexp_extract_all(col(c), F.lit(rf"(?=[{initials}])(?<![A-Za-z0-9_]){shape}(?![A-Za-z0-9_])"), F.lit(0))
    part = lambda p, i: F.regexp_extract(p, f"^{shape}$", i)
    return F.array_distinct(F.transform(found, lambda p: F.concat_ws("-", part(p, 1), F.translate(part(p, 2), "/-", ""), F.nullif(part(p, 3), F.lit("")))))
