"""Merkle manifest of a table with parent-preimage paths.

Every row is a leaf, the digest of its fields. The leaves of a group, in order of their ids, are hashed in runs of
``arity`` until one node remains, the group's subroot; the subroots, in order of their groups, likewise give the root.
Digests are lowercase hex, 64 characters.

What is stored is each parent's preimage: its children's digests, joined. A leaf needs no other table to prove its place: it
joins its ancestors' preimages; excising its own 64-character slot from each leaves the siblings, and splicing
another digest into the slot and hashing gives what the parent would be, so that folding from a changed leaf gives the
root that the change leads to.

1. Leaves are hashed in one read of the table and written, some 150 bytes a row. They are sorted over ranges of (group, id),
   so a group with most rows is many tasks' work; a row's number in its range plus the counts of the ranges before is its place.
2. Up: aligned blocks of ``arity ** LEVELS`` nodes are one small array each, hashed LEVELS levels at a time; a block keeps the
   preimages of its levels and hands its top on. Rounds: the depth over LEVELS, seven for 10 ** 10 rows; each writes a table
   an ``arity ** LEVELS``-th of the one before.
3. Down: a block joins the block above it, which adds the preimages of its further ancestors; last the leaves join
   their blocks. Keys of these joins are (group, block): a large group is as many keys as it has blocks.

The driver sees depths and the root, nothing that grows with the table.

Rows: a null field counts as ``-``, another as its number of bytes, a colon and itself; a null group is first, other
groups follow by their bytes; null ids are first in their group, rows of one id are in order of their digests, so repeated rows are leaves of their own;
ids are integers and may have any name, other columns are ignored. A table without rows has no root and gives no
rows; a single row's leaf is its subroot and root, its siblings are the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked_by_sort, saved

#: Levels that a block holds; characters of a digest.
LEVELS, HEX = 5, 64


def field(value: Column) -> Column:
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def digest(parts: list[Column]) -> Column:
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """A string that orders as groups do and is never null: null groups first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def div(value: Column, by: int) -> Column:
    return ((value - value % by) / by).cast("long") if by <= 1 << 20 else F.call_function("div", value, F.lit(by))


def depth_of(n: Column, arity: int) -> Column:
    """The least depth at which arity ** depth is n or more."""
    powers = [arity**k for k in range(1, 64) if arity**k < 1 << 62]
    return F.aggregate(F.array(*map(F.lit, [1, *powers])), F.lit(0), lambda d, p: d + (p < n).cast("int"))


def hashed_block(nodes: Column, levels: Column, arity: int) -> Column:
    """nodes: digests in order. ``preimages`` of each of the levels above them, and the digests of the last, ``nodes``."""
    start = F.struct(F.array().cast("array<array<string>>").alias("preimages"), nodes.alias("nodes"))

    def level(state: Column) -> Column:
        n = state["nodes"]
        runs = F.transform(F.sequence(F.lit(0), F.size(n) - 1, F.lit(arity)), lambda i: F.array_join(F.slice(n, i + 1, arity), ""))
        return F.transform(F.array(runs), lambda p: F.struct(F.concat(state["preimages"], F.array(p)).alias("preimages"), F.transform(p, lambda x: F.sha2(x, 256)).alias("nodes")))[0]

    return F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), levels), start, lambda state, _: level(state))).otherwise(start)


def grow(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes: ``tree, at, hash, n``, n the tree's nodes. The blocks of each round, ``tree, block, left, preimages``
    (left: levels from the block's nodes to the tree's top), and ``tree, top``."""
    width, rounds = arity**LEVELS, []
    level = nodes.select("tree", "at", "hash", depth_of(F.col("n"), arity).alias("left"))
    tops = [level.where("left = 0")]
    deepest = level.agg(F.coalesce(F.max("left"), F.lit(0))).first()[0]
    for _ in range(-(-deepest // LEVELS)):
        blocks = level.where("left > 0").groupBy("tree", div(F.col("at"), width).alias("block"), "left").agg(F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("nodes"))
        blocks = blocks.withColumn("made", hashed_block(F.transform("nodes", lambda x: x["hash"]), F.least(F.col("left"), F.lit(LEVELS)), arity))
        blocks = saved(blocks.select("tree", "block", "left", F.col("made.preimages").alias("preimages"), F.col("made.nodes")[0].alias("top")), "merkle-blocks")
        rounds.append(blocks)
        level = blocks.select("tree", F.col("block").alias("at"), F.col("top").alias("hash"), F.greatest(F.col("left") - LEVELS, F.lit(0)).alias("left"))
        tops.append(level.where("left = 0"))
    top = tops[0]
    for other in tops[1:]:
        top = top.union(other)
    return rounds, top.select("tree", F.col("hash").alias("top"))


def ancestors(i: Column, arity: int) -> dict[str, Column]:
    """Of the i-th node of a block with columns ``preimages``, ``above`` and ``above_slots``: the preimages of all its
    ancestors, lowest first, and its or its ancestor's slot in each."""
    at = lambda k: div(i, arity**k).cast("int")
    own = F.array_compact(F.array(*(F.get(F.get("preimages", F.lit(k)), at(k + 1)) for k in range(LEVELS))))
    slots = F.array_compact(F.array(*(F.when(F.size("preimages") > k, at(k) % arity) for k in range(LEVELS))))
    return {"path": F.concat(own, F.col("above")), "slots": F.concat(slots, F.col("above_slots"))}


def descend(rounds: list[DataFrame], heads: DataFrame, arity: int) -> DataFrame | None:
    """heads: ``tree, top, path, slots`` above each tree's top. The lowest blocks with ``top, above, above_slots``: the tree's
    top and the ancestors of the block's own top."""
    width, known = arity**LEVELS, None
    heads = heads.withColumnsRenamed({"path": "above", "slots": "above_slots"})
    for blocks in reversed(rounds):
        blocks = blocks.drop("top")
        found = blocks.where(F.col("left") <= LEVELS).join(heads, "tree")
        if known is not None:
            upper = known.select("tree", F.col("block").alias("upper"), "top", F.col("preimages").alias("upper_preimages"), "above", "above_slots")
            lower = blocks.where(F.col("left") > LEVELS).withColumn("upper", div(F.col("block"), width)).join(upper, ["tree", "upper"])
            own = ancestors(F.col("block") % width, arity)
            lower = lower.withColumnsRenamed({"preimages": "kept", "upper_preimages": "preimages"}).withColumns(own)
            found = found.unionByName(lower.select("tree", "block", "left", F.col("kept").alias("preimages"), "top", F.col("path").alias("above"), F.col("slots").alias("above_slots")))
        known = saved(found, "merkle-paths")
    return known


def joined_paths(nodes: DataFrame, rounds: list[DataFrame], heads: DataFrame, arity: int) -> DataFrame:
    """nodes with ``top``, their tree's, and ``path`` and ``slots``, all their ancestors' preimages and their place in each."""
    width = arity**LEVELS
    lone = nodes.where("n = 1").join(heads, "tree")
    lowest = descend(rounds, heads, arity)
    if lowest is None:
        return lone
    many = nodes.where("n > 1").withColumn("block", div(F.col("at"), width)).join(lowest.drop("left"), ["tree", "block"])
    many = many.withColumns(ancestors(F.col("at") % width, arity)).select(*lone.columns)
    return lone.unionByName(many)


def siblings(path: str = "path", slots: str = "slots") -> Column:
    """The digests of the siblings at every level, lowest first, joined: each preimage without the own slot."""
    cut = lambda p, s: F.concat(F.substring(p, F.lit(1), s * HEX), F.substring(p, s * HEX + HEX + 1, F.char_length(p)))
    return F.array_join(F.zip_with(path, slots, cut), "")


def fold(leaf: Column, path: str = "path", slots: str = "slots") -> Column:
    """The root that a leaf's digest leads to: spliced into its slot, hashed, spliced into the next."""
    splice = lambda h, x: F.sha2(F.concat(F.substring(x["p"], F.lit(1), x["s"] * HEX), h, F.substring(x["p"], x["s"] * HEX + HEX + 1, F.char_length(x["p"]))), 256)
    return F.aggregate(F.zip_with(path, slots, lambda p, s: F.struct(p.alias("p"), s.alias("s"))), leaf, splice)


def build(rows: DataFrame, fields: list[Column], *, group: Column, id_col: str, changed: tuple[Column, list[Column]] | None = None, arity: int = 2) -> DataFrame:
    """``id, leaf, changed, subroot, root, path, slots`` of every row. changed: the rows that are tampered with and what
    their fields become; the column holds the digest of those, null elsewhere."""
    other = F.when(changed[0], digest([field(f) for f in changed[1]])) if changed else F.lit(None).cast("string")
    leaves = rows.select(F.col(id_col).alias("id"), group_key(group).alias("tree"), digest([field(f) for f in fields]).alias("hash"), other.alias("changed"))
    leaves = ranked_by_sort(saved(leaves, "merkle-digests"), ["tree"], [F.asc_nulls_first("id"), F.col("hash")], "at", "merkle-leaves", "n")
    leaves = saved(leaves, "merkle-places")
    rounds, tops = grow(leaves, arity)
    roots = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("hash"))
    roots = saved(ranked_by_sort(roots, ["tree"], [F.col("name")], "at", "merkle-groups", "n"), "merkle-roots")
    above, found = grow(roots, arity)
    root = (found.first() or {"top": None})["top"]
    head = rows.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(root).cast("string").alias("top"), F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("slots"))
    heads = joined_paths(roots, above, head, arity).select(F.col("name").alias("tree"), F.col("hash").alias("top"), "path", "slots")
    told = joined_paths(leaves, rounds, heads, arity)
    return told.select("id", F.col("hash").alias("leaf"), "changed", F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "path", "slots")
