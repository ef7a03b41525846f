"""Quality rules with adaptive thresholds, in DataFrame operations only.

Four measures are taken of every text: characters a word, symbols a thousand characters, repeated lines a thousand
lines, words in repeated three-word windows a thousand words. Where a cutoff would be fixed, each language and source
has its own: fences beside the quantiles of what its texts measure, by a mergeable quantile sketch.

The sketch is a histogram over bins of relative width: a value's highest binary digits (``PRECISION`` beyond the first)
are its bin, so a quantile is off by at most 1 in 2 ** PRECISION of itself. Counts of bins add up: a task counts its
own rows, shuffles move one number a bin, a source with a third of all rows costs no more than another, and the
sketches of a language's sources merge to that of the language, which stands in for sources of fewer than ``min_rows``
texts, as the sketch of all texts does for languages. The result doesn't depend on the order of rows or merges.

Fences: the upper one is the third quartile plus ``reach`` times the distance from the first to the third quartile, or times the
measure's least distance (``LEAST``) where texts are so alike that the quartiles nearly meet; the lower one, for characters a word alone,
likewise below the first quartile. A text is kept if it doesn't fail the base rules and is within all fences.
Texts that fail the base rules say nothing about what is usual, and stay out of the sketches.

Texts are read once: measures, some 80 bytes a row, are written to the shared folder, and read for sketches and for the join
with the fences. That join is left to adaptive execution, which broadcasts the fences if they turn out small and splits
a hot source if not.

Words: runs of characters other than ASCII white space. Rows: null and empty texts have no words, measure 0 and fail
the base rules; null languages and sources are groups of their own; repeated rows count and are judged each; other
columns are ignored, ids may have any name and type; a table without rows gives none. A very long text is one array of words in its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

WHITE, SYMBOLS = "\t\n\x0b\f\r ", "#*$%&|<>"
PRECISION = 5
#: Measures and the least distance between their quartiles that counts.
LEAST = {"word_length": 40, "symbol_share": 20, "line_share": 100, "repeat_share": 50}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row."""
    return F.transform(F.array(value), f)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    windows = F.when(F.size(words) > 2, F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)).otherwise(F.array().cast("array<string>"))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, s: n + s)

    def twice(ordered: Column) -> Column:
        told = lambda x, i: (x["w"] == F.get(ordered, i - 1)["w"]) | (x["w"] == F.get(ordered, i + 1)["w"])
        return F.sort_array(F.transform(F.filter(ordered, told), lambda x: x["at"]))

    def count(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
        # without repeats there is nothing to sort
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(let(let(ordered, twice), covered))

    return let(windows, count)


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id, lang, source`` with counts and the measures of ``LEAST``, as whole numbers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = lambda found: F.struct(F.size(found).alias("n"), (F.size(found) - F.size(F.array_distinct(found))).alias("again"))
    told = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again"))).alias("words"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines).alias("lines"),
        F.char_length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    n, n_lines = F.col("words.n"), F.col("lines.n")
    share = lambda k, of, by=1000: F.coalesce(F.floor(F.lit(by) * k / F.nullif(of, F.lit(0))), F.lit(0)).cast("long")
    return told.select(
        "id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", F.col("lines.again").cast("long").alias("n_dup_lines"), F.col("words.again").alias("n_repeat_words"),
        share(F.col("word_chars"), n, 100).alias("word_length"), share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        share(F.col("lines.again"), n_lines).alias("line_share"), share(F.col("words.again"), n).alias("repeat_share"))


def bin_of(v: Column) -> Column:
    """The least value of v's bin: its binary digits with all but the highest ``PRECISION + 1`` set to 0."""
    low = F.greatest(F.char_length(F.bin(v)) - (PRECISION + 1), F.lit(0))
    unit = F.pow(F.lit(2.0), low).cast("long")
    return v - v % unit


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, bin, n``: one histogram a key and measure."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("bin")) for m in LEAST)))
    return rows.select(*keys, each.alias("b")).groupBy(*keys, F.col("b.measure").alias("measure"), F.col("b.bin").alias("bin")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, rows, q1, q3``: the bins that hold the values of rank ceil(rows / 4) and ceil(3 rows / 4)."""
    key = W.partitionBy(*keys, "measure")
    ranked = sketches.withColumn("upto", F.sum("n").over(key.orderBy("bin"))).withColumn("rows", F.sum("n").over(key))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, F.col("bin")))
    return ranked.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(1).alias("q1"), at(3).alias("q3"))


def fences(rows: DataFrame, *, reach: int = 3, min_rows: int = 100) -> DataFrame:
    """``lang, source, fences``: for each measure the values a text may have at least and at most."""
    by_source = saved(sketch(rows, ["lang", "source"]), "quality-sketches")
    by_lang = merged(by_source, ["lang"])
    overall = quartiles(merged(by_lang, []), []).select("measure", *(F.col(c).alias(f"all_{c}") for c in ("q1", "q3")))
    langs = quartiles(by_lang, ["lang"]).select(F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), *(F.col(c).alias(f"lang_{c}") for c in ("rows", "q1", "q3")))
    found = quartiles(by_source, ["lang", "source"]).join(langs, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure"))).join(F.broadcast(overall), "measure")
    pick = lambda q: F.when(F.col("rows") >= min_rows, F.col(q)).when(F.col("lang_rows") >= min_rows, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}"))
    least = F.create_map(*(F.lit(x) for pair in LEAST.items() for x in pair))[F.col("measure")]
    span = F.greatest(pick("q3") - pick("q1"), least) * reach
    low = F.when(F.col("measure") == "word_length", pick("q1") - span).otherwise(F.lit(0))
    limits = F.struct(low.cast("long").alias("low"), (pick("q3") + span).cast("long").alias("high"))
    return found.groupBy("lang", "source").pivot("measure", list(LEAST)).agg(F.first(limits))


def judge(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, reach: int = 3, min_rows: int = 100, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id_col``, the counts, ``base_failed``, ``failed`` (the measures outside their fences) and ``kept``."""
    rows = saved(measured(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col), "quality-measures")
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    limits = fences(rows.where(~base_failed), reach=reach, min_rows=min_rows).withColumnsRenamed({m: f"{m}_limits" for m in LEAST} | {"lang": "_lang", "source": "_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    outside = F.array_compact(F.array(*(F.when(~F.col(m).between(F.col(f"{m}_limits.low"), F.col(f"{m}_limits.high")), F.lit(m)) for m in LEAST)))
    out = joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), outside.alias("failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
