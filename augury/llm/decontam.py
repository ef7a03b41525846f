"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item's windows are its runs of ``window`` words (an item of fewer words is one window). Containment
asks for all words of a window, so its necessary prefix is one word: the one rarest in the documents. Windows
of an item that share that word at the same place form one anchor. The join is on anchor words alone; length
and position bounds cut an anchor to the windows that fit in the document, a neighbour of the anchor word must
agree, and what is left is verified word by word.

Scale: documents are read and split three times (word counts, candidates, sizes) and never shuffled: what moves
are counts of benchmark words, candidate anchors with the words around them, and one small row per document.
Benchmark tables go to all executors while their size is under ``broadcast_bytes`` (it is checked); beyond it,
positions are joined by shuffle and documents are read again for the candidates alone. A common passage costs
each document that holds it a few rows; documents are never paired with each other.

Words: runs of characters other than ASCII ones that are no letters or digits, A-Z lower-cased.

Rows: null and empty texts have no words; an item without words has no windows; repeated rows each keep their
result; items of equal texts count each under its own id, which may be of any type; ids may have any name; other columns are ignored; empty tables on either
side give rows without hits, or no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words: every ASCII character but digits and letters.
PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), PARTING), "")


def loose(word: Column | str) -> Column:
    """Hash of a word for joining: coarser than equality of words, which is checked afterwards."""
    return F.xxhash64(F.lower(word))


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """``item_id, h, at, first, last, length, words``: the windows starting at first..last of an item have their
    rarest word at position ``at``; words are those from first to the end of the last window."""
    listed = items.select("item_id", "item_words", F.posexplode("item_words").alias("at", "w")).withColumn("h", loose("w"))
    rare = (listed.join(counts, "h", "left").groupBy("item_id", "item_words")
            .agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "h"))).alias("listed")))
    size = F.size("listed")
    length = F.least(F.lit(window), size)
    starts = rare.select("item_id", "item_words", length.alias("length"), "listed", F.explode(F.sequence(F.lit(0), size - length)).alias("start"))
    rarest = F.array_min(F.transform(F.slice("listed", F.col("start") + 1, F.col("length")), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["h"].alias("h"))))
    return (starts.withColumn("r", rarest).groupBy("item_id", "item_words", "length", F.col("r.at").alias("at"), F.col("r.h").alias("h"))
            .agg(F.min("start").alias("first"), F.max("start").alias("last"))
            .select("item_id", "h", "at", "first", "last", "length", F.slice("item_words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("length")).alias("words")))


def _candidates(joined: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """joined: a document's words, a position pos in them and an anchor. Bounds and the neighbour test."""
    base = F.col("pos") - F.col("at")  # where the item's first word would be
    low, high = F.greatest(F.col("first"), -base), F.least(F.col("last"), n - F.col("length") - base)
    agrees = lambda d: F.coalesce(F.lower(F.get("doc_words", F.col("pos") + d)) == F.lower(F.get("words", F.col("at") - F.col("first") + d)), F.lit(False))
    span = high - low + F.col("length")
    return (joined.where((low <= high) & ((F.col("length") == 1) | agrees(-1) | agrees(1)))
            .select(*keys, F.struct("item_id", (base + low).alias("start"), F.col("length"), F.slice("words", low - F.col("first") + 1, span).alias("ours"),
                                    F.slice("doc_words", base + low + 1, span).alias("theirs")).alias("c")))


def _verified(cands: Column) -> Column:
    """Exact: ``item_id, start, length`` of each window that occurs."""

    def windows(c: Column) -> Column:
        theirs = F.transform(c["theirs"], ascii_lower)
        fits = F.filter(F.sequence(F.lit(0), F.size(c["ours"]) - c["length"]), lambda i: F.slice(c["ours"], i + 1, c["length"]) == F.slice(theirs, i + 1, c["length"]))
        return F.transform(fits, lambda i: F.struct(c["item_id"].alias("item_id"), (c["start"] + i).alias("start"), c["length"].alias("length")))

    return F.flatten(F.transform(cands, windows))


def _covered(found: Column) -> Column:
    """Words inside any window: the size of the union of intervals."""
    spans = F.array_sort(F.transform(found, lambda w: F.struct(w["start"].alias("a"), (w["start"] + w["length"]).alias("b"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, w: F.struct(F.greatest(s["end"], w["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), w["b"] - F.greatest(s["end"], w["a"]))).alias("n"))
    return F.aggregate(spans, zero, step, lambda s: s["n"])


def find_windows(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``id_col, n_words, hits, n_hit, items`` of every row of docs: hits are the windows found
    (item_id, start, length; starts from 0), n_hit the words inside any, items the sorted ids as strings."""
    items = (benchmark.select(F.col(item_col).alias("item_id"), split_words(ascii_lower(item_text_col)).alias("item_words"))
             .where("size(item_words) > 0").distinct())
    item_type = items.schema["item_id"].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_text"), split_words(F.col(text_col)).alias("doc_words"))
    vocabulary = items.select(F.explode("item_words").alias("w")).select(loose("w").alias("h")).distinct()
    n_words, n_bytes = items.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.array_join("item_words", " "))), F.lit(0))).first()
    small = n_bytes * 20 + n_words * 60 <= broadcast_bytes  # a bound of what the anchors of all items hold
    shared = F.broadcast if small else (lambda df: df)
    counts = given.select(F.explode("doc_words").alias("w")).select(loose("w").alias("h")).join(shared(vocabulary), "h", "left_semi" if not small else "inner").groupBy("h").agg(F.count("*").alias("n"))
    found = anchors(items, counts, window)
    keys = ["_doc", "_text"]
    if small:
        joined = given.select(*keys, "doc_words", F.posexplode("doc_words").alias("pos", "w")).withColumn("h", loose("w")).join(F.broadcast(found), "h")
        cands = _candidates(joined, keys, F.size("doc_words"))
    else:
        placed = given.select(*keys, F.posexplode("doc_words").alias("pos", "w")).select(*keys, "pos", loose("w").alias("h"))
        wanted = placed.join(found, "h").select(F.col("_doc").alias("_i"), F.col("_text").alias("_t"), "pos", "item_id", "at", "first", "last", "length", "words")
        joined = given.dropDuplicates(keys).join(wanted, F.col("_doc").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")))
        cands = _candidates(joined, keys, F.size("doc_words"))
    hits = cands.groupBy(*keys).agg(F.array_distinct(_verified(F.collect_set("c"))).alias("hits")).withColumnsRenamed({"_doc": "_i", "_text": "_t"})
    sized = given.select(*keys, F.size("doc_words").cast("long").alias("n_words"))
    none = F.array().cast(f"array<struct<item_id:{item_type},start:int,length:int>>")
    out = sized.join(hits, F.col("_doc").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")), "left")
    out = out.select("_doc", "n_words", F.coalesce("hits", none).alias("hits"))
    return out.select(F.col("_doc").alias(id_col), "n_words", "hits", _covered(F.col("hits")).alias("n_hit"), F.array_sort(F.array_distinct(F.transform("hits", lambda w: w["item_id"].cast("string")))).alias("items"))
