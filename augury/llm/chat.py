"""Quotation linking for chat formatting, in DataFrame operations only.

Lines that begin with ``>`` marks are quotes; the number of marks is their level. Neighbouring lines of one
level form a passage. Passages are normalised (A-Z lower-cased, white space runs to one space, trimmed) and
hashed; quoted ones are joined, within their conversation, to the first message that holds the passage
unquoted, as its whole own text, as a passage, or as one line. A quoted passage that is found nowhere as a
whole is sought line by line. A message answers the latest earlier message that its outermost linked level
quotes. Messages come back without quotes, and without a line before a quote that says who wrote it, in reply order:
messages that answer one another form a thread, threads follow their first turns, and inside a thread messages follow
their turns, so that each stands behind the message it answers and nothing of another thread between.

Scale: a message is taken apart inside its own row, and its text moves twice: to drop repeated rows, and to meet
its result. What the joins move are hashes. Each (conversation, hash) keeps only its first turn before the join,
so the join is one row to each quote and no two messages are paired; a hot hash or conversation is split by AQE.
Threads are found by pointer jumping over the linked turns alone (the logarithm of the longest chain in rounds).
Positions in a conversation are numbers in ranges of one sort, shifted by the counts of the ranges before, so neither a
very long conversation nor a thread in which all answer one message needs a single task.

Rows: repeated rows are one message; null text is an empty message that quotes nothing; null conversation ids
or turns link to nothing but are kept; ties in turn follow role and the md5 of the text; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked_by_sort, saved

_MARKS = r"^((?:[ \t]*>)*)"
_SPACE = r"[ \t\r\n]+"
#: How a line before a quote says who wrote it.
ATTRIBUTION = r"(?i)^[ \t]*((on|am|le|el) .*)?(wrote|writes|schrieb|a écrit|escribió)[^a-z]*:[ \t\r]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _SPACE, " "))


def _hash(text: Column) -> Column:
    """Of normalised text; null where nothing is left of it."""
    t = normalised(text)
    return F.when(t != "", F.unhex(F.md5(t)))


def _parsed(text: Column) -> Column:
    """Lines as (level, line); a line that tells whose words the quote after it holds has level -1."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("line"))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)
    said = lambda x, i: (x["level"] == 0) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0) & x["line"].rlike(ATTRIBUTION)
    return F.transform(lines, lambda x, i: F.when(said(x, i), F.struct(F.lit(-1).alias("level"), x["line"].alias("line"))).otherwise(x))


def _passages(lines: Column) -> Column:
    """Runs of lines of one level: (level, lines)."""
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(lines, a)["level"].alias("level"), F.transform(F.slice(lines, a + 1, b - a), lambda x: x["line"]).alias("lines")))


def _roots(linked: DataFrame) -> DataFrame:
    """``conv_id, turn, root`` of the turns that answer an earlier one: the turn their chain of answers begins with."""
    jumps = saved(linked.groupBy("conv_id", "turn").agg(F.min("parent").alias("root")), "replies")
    while True:
        far = jumps.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("beyond"))
        new = saved(jumps.join(far, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "replies")
        jumps = new.drop("moved")
        if new.where("moved").isEmpty():
            return jumps


def link_quotes(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text (without quotes), n_quoted, n_linked, max_level, parent_turn, reply_pos``."""
    told = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("raw"))
    told = told.withColumn("m", F.unhex(F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "raw")), 256))).dropDuplicates(["m"])
    parsed = told.withColumn("lines", _parsed(F.col("raw"))).withColumn("passages", _passages(F.col("lines")))
    mine = lambda xs: F.filter(xs, lambda x: x["level"] == 0)
    joined = lambda x: F.array_join(x["lines"], " ")
    own = F.array_join(F.transform(mine(F.col("lines")), lambda x: x["line"]), "\n")
    sources = F.concat(F.array(_hash(own)), F.transform(mine(F.col("passages")), lambda x: _hash(joined(x))), F.transform(mine(F.col("lines")), lambda x: _hash(x["line"])))

    def units(x: Column, i: Column) -> Column:
        unit = lambda part, h: F.struct(i.alias("passage"), x["level"].alias("level"), F.lit(part).alias("part"), h.alias("hash"))
        return F.when(x["level"] > 0, F.concat(F.array(unit(0, _hash(joined(x)))), F.transform(x["lines"], lambda y: unit(1, _hash(y)))))

    quoted = F.filter("passages", lambda x: x["level"] > 0)
    made = saved(parsed.select(
        "m", "conv_id", "turn", "role", F.trim(own).alias("text"), F.md5(F.trim(own)).alias("text_md5"), F.array_distinct(F.filter(sources, lambda h: h.isNotNull())).alias("sources"),
        F.flatten(F.filter(F.transform("passages", units), lambda u: u.isNotNull())).alias("units"), F.size(quoted).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform(quoted, lambda x: x["level"])), F.lit(0)).alias("max_level")), "messages")
    first = made.select("conv_id", "turn", F.explode("sources").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("source_turn"))
    links = made.where("n_quoted > 0").select("m", "conv_id", "turn", F.inline("units")).where("hash is not null").join(first, ["conv_id", "hash"]).where("source_turn < turn")
    # a passage counts as a whole if it links as one, else by its lines
    best = links.groupBy("m", "passage", "level", "part").agg(F.max("source_turn").alias("source_turn")).groupBy("m", "passage", "level").agg(F.min(F.struct("part", "source_turn")).alias("b"))
    linked = best.groupBy("m", "level").agg(F.max("b.source_turn").alias("source_turn"), F.count("*").alias("n")).groupBy("m").agg(F.min(F.struct("level", "source_turn")).alias("b"), F.sum("n").alias("n_linked"))
    linked = saved(linked, "linked")
    narrow = made.select("m", "conv_id", "turn", "role", "text_md5").join(linked.select("m", F.col("b.source_turn").alias("parent"), "n_linked"), "m", "left")
    answers = narrow.where("parent IS NOT NULL").select("conv_id", "turn", "parent")
    if answers.isEmpty():
        narrow = narrow.withColumn("root", F.col("turn"))
    else:
        roots = _roots(answers)
        own = narrow.join(roots, ["conv_id", "turn"], "left")  # all messages of a turn stand in its thread
        narrow = own.withColumn("root", F.coalesce("root", "turn"))
    order = [F.col("root"), F.col("turn"), F.col("role"), F.col("text_md5")]
    placed = ranked_by_sort(narrow, ["conv_id"], order, "reply_pos", "replies-in-order")
    out = made.join(placed.select("m", "parent", "n_linked", F.col("reply_pos").cast("long").alias("reply_pos")), "m")
    return out.select("conv_id", "turn", "role", "text", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "max_level", F.col("parent").alias("parent_turn"), "reply_pos")
