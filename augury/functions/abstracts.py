"""Cleaning of abstracts before they are embedded: each step is an expression of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import col

# Character references.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# Section labels.
LABELS = (
    "abstract", "graphical abstract", "summary", "background", "backgrounds", "introduction",
    "context", "objective", "objectives", "aim", "aims", "purpose", "rationale", "importance",
    "method", "methods", "methodology", "materials and methods", "material and methods",
    "design", "setting", "settings", "participants", "subjects", "interventions",
    "main outcome measures", "measurements", "result", "results", "findings",
    "conclusion", "conclusions", "discussion", "interpretation", "significance",
    "implications", "limitations", "highlights", "keywords", "key words",
)
ANY_LABEL = f"(?:{'|'.join(LABELS)})"
BREAK = "\u0001"
#: Of a text only so many characters at an end are held against labels, all of which are shorter.
REACH = 40


def letting(value: Column, f) -> Column:
    """f of a value that is computed once a row."""
    return F.transform(F.array(value), f)[0]


def longest(told: Column) -> Column:
    """Of the labels that told() accepts the longest, null without any. told() runs for every label: it must not work through a whole text."""
    return F.get(F.filter(F.array(*map(F.lit, sorted(LABELS, key=len, reverse=True))), told), F.lit(0))


def resolved(x: Column) -> Column:
    """References to characters, escaped once or twice."""
    out = x
    for name, char in ENTITIES * 2:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(x.contains("&"), out).otherwise(x)


def without_markup(x: Column) -> Column:
    """What stands after a ``<`` up to its ``>`` goes if it begins like a tag; a lone ``<`` stays."""
    parts = F.split(x, "<")
    tag = lambda p: p.rlike("^/?[A-Za-z]") & (F.instr(p, ">") > 0)
    rest = lambda p: F.substring(p, F.instr(p, ">") + 1, F.length(p))
    out = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).when(tag(p), F.concat(F.lit(" "), rest(p))).otherwise(F.concat(F.lit("<"), p))), "")
    return F.when(x.contains("<"), out).otherwise(x)


def without_notice(x: Column) -> Column:
    """Sentences at the end that claim rights go; one in the middle stays, with all that follows it."""
    parts = F.split(F.replace(F.replace(x, F.lit(". "), F.lit(f".{BREAK} ")), F.lit("©"), F.lit(f"{BREAK}©")), BREAK)

    def notice(p: Column) -> Column:
        starts = lambda low: low.startswith("©") | low.startswith("(c) ") | low.startswith("copyright") | low.startswith("this article is protected by copyright")
        return letting(F.ltrim(F.lower(p)), lambda low: starts(low) | low.contains("all rights reserved") | (low == ""))

    # most texts end in none: their last sentence tells
    tail = F.substring_index(F.substring_index(x, BREAK, -1), ". ", -1)
    ends = letting(tail, lambda p: p.contains("©") | notice(p))
    last = lambda ps: F.aggregate(F.transform(ps, lambda p, i: F.when(notice(p), 0).otherwise(i + 1)), F.lit(0), lambda a, b: F.greatest(a, b))
    cut = letting(parts, lambda ps: F.array_join(F.slice(ps, 1, last(ps)), ""))
    return F.when(ends, cut).when(x.contains(BREAK), F.replace(x, F.lit(BREAK), F.lit(""))).otherwise(x)


def without_source_tag(x: Column) -> Column:
    """A leading [source tag] of at most 80 characters."""
    end = F.instr(x, "]")
    return F.when(x.startswith("[") & end.between(3, 82), F.ltrim(F.substring(x, end + 1, F.length(x)))).otherwise(x)


def without_leading_label(x: Column) -> Column:
    """One label at the start, before a mark, or before white space and a capital, a figure or an opening quote."""
    def told(head: Column, label: Column) -> Column:
        return head.startswith(label) & ~F.substring(x, F.length(label) + 1, F.lit(1)).rlike("^[A-Za-z]")

    def cut(label: Column) -> Column:
        behind = F.substring(x, F.length(label) + 1, F.length(x))
        rest = F.ltrim(behind)
        marked = rest.rlike("^[:.–—-]")
        return F.when(marked, F.ltrim(F.substring(rest, F.lit(2), F.length(rest)))).when((rest != behind) & rest.rlike("^[A-Z0-9\"'(]"), rest).otherwise(x)

    found = letting(F.lower(F.substring(x, 1, REACH)), lambda head: F.when(head.rlike(f"^{ANY_LABEL}"), longest(lambda label: told(head, label))))
    return letting(found, lambda label: F.when(label.isNull(), x).otherwise(cut(label)))


def without_inner_labels(x: Column) -> Column:
    """Labels before a colon: both go; the word alone stays."""
    parts = F.split(x, ":")

    def told(end: Column) -> Column:
        found = lambda low: longest(lambda label: low.endswith(label) & ~F.substring(end, -F.length(label) - 1, F.lit(1)).rlike("^[A-Za-z]") | (low == label))
        return letting(F.lower(end), lambda low: F.when(low.rlike(f"{ANY_LABEL}$"), found(low)))

    def cut(p: Column, said: Column) -> Column:
        found = letting(F.substring(said, -REACH, REACH), told)
        return letting(found, lambda label: F.when(label.isNull(), F.concat(p, F.lit(":"))).otherwise(F.concat(F.substring(said, F.lit(1), F.length(said) - F.length(label)), F.lit(" "))))

    out = letting(parts, lambda ps: F.array_join(F.transform(ps, lambda p, i: F.when(i == F.size(ps) - 1, p).otherwise(letting(F.rtrim(p), lambda said: cut(p, said)))), ""))
    return F.when(x.contains(":"), out).otherwise(x)


def spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[\t-\r][\t-\r ]*| [\t-\r ]+", " "))  # single spaces stay as they are


def clean_text(c: Column | str, stacked: int = 4) -> Column:
    """What an embedder reads: no references, markup, notices of rights, source tag, up to ``stacked`` labels at the
    start, labels before colons, or runs of white space. Null reads as empty."""
    x = F.coalesce(col(c), F.lit(""))
    for step in (resolved, without_markup, spaced, without_notice, without_source_tag, *[without_leading_label] * stacked, without_inner_labels):
        x = letting(x, step)
    return spaced(x)


def embed_text(title: Column, cleaned: Column, budget: int = 500) -> Column:
    """A title and, on the next line, what ``budget`` leaves of a text that was cleaned before it is cut."""
    return F.concat(title, F.lit("\n"), F.substring(cleaned, 1, budget))
