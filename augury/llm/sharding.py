"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts form one indivisible group. Groups enter, largest first, the bin whose remaining
capacity is the tightest that holds them; a balanced search tree over remaining capacities finds it, and a
new bin opens when none does.

Scale: groups of one size are interchangeable, so the packing runs over (size, count) pairs. Distinct group
sizes number at most sqrt(2 * total bytes), since d of them add up to at least d * d / 2; that table is all
the driver sees. It answers with runs (size, first rank, last rank, bin); ranks of groups within a size, and
slots of rows within a shard, are counted in two levels over salted parts, so no size, shard or group of
copies has to fit in one task.

Rows: a null text counts as an empty one (size 1, crc 0, one group with empty texts); a group larger than the
even share of the bins gets a bin of its own, and the other groups are packed evenly into the bins that remain;
repeated rows each get their own slot; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved


class CapacityTree:
    """Treap of (remaining capacity, bin): insert, and take out the tightest that holds a size. Priorities are
    hashed from the bins, so that the tree stays balanced and the result the same each time."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    @staticmethod
    def _split(node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Keys below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = CapacityTree._split(node[3], key)
            return node, right
        left, node[2] = CapacityTree._split(node[2], key)
        return left, node

    @staticmethod
    def _join(a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = CapacityTree._join(a[3], b)
            return a
        b[2] = CapacityTree._join(a, b[2])
        return b

    def insert(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, (bin_ * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 61), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest (remaining, bin) with remaining >= size, removed; None if there is none."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._join(low, rest)
        return node[0]


def pack(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best fit decreasing over (size, count) pairs: runs (size, count, bin). None as soon as more than ``most``
    bins are needed. What fits a bin goes on fitting it best until it no longer fits, so a run is one step."""
    tree, bins, runs = CapacityTree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        while count:
            found = tree.take(size)
            if found is None:
                if most is not None and bins == most:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            remaining, bin_ = found
            n = min(count, remaining // size)
            runs.append((size, n, bin_))
            tree.insert(remaining - n * size, bin_)
            count -= n
    return runs


def even_packing(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Runs (size, count, bin) over at most ``bins`` bins: a group above the even share of the bins that are left
    has a bin of its own, largest first, until none is; the others are packed into the bins that then remain."""
    left, runs, total = sorted(sizes, reverse=True), [], sum(s * n for s, n in sizes)
    while left and left[0][0] > -(-total // (bins - len(runs))):  # never with one bin left
        size, count = left[0]
        left[:1] = [(size, count - 1)] if count > 1 else []
        runs.append((size, 1, len(runs)))
        total -= size
    own = len(runs)
    return runs + [(size, n, bin_ + own) for size, n, bin_ in even_capacity(left, bins - own)]


def even_capacity(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """The packing of the smallest capacity found (by halving) that needs at most ``bins`` bins."""
    if not sizes:
        return []
    total = sum(s * n for s, n in sizes)
    low = max(-(-total // bins), max(s for s, _ in sizes))
    best, step = pack(sizes, low, bins), max(1, low // 1000)
    if best is not None:
        return best
    high = low
    while best is None:
        low, high, step = high, high + step, step * 2
        best = pack(sizes, high, bins)
    while high - low > max(1, high // 1_000_000):
        mid = (low + high) // 2
        found = pack(sizes, mid, bins)
        low, high, best = (mid, high, best) if found is None else (low, mid, found)
    return best


def rank_within(df: DataFrame, key: list[str], order: list[Column], salt: Column, out: str) -> DataFrame:
    """Gapless ranks from 0 within each key, counted within (key, salt) and shifted by the counts of the salts
    before: no task needs all rows of a key."""
    salted = df.withColumn("_salt", salt)
    counts = salted.groupBy(*key, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    shifts = counts.select(*key, "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(*key, "_salt").orderBy(*order)) - 1
    shifts = shifts.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*key, "_salt"])), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*key, "_salt"])]
    return salted.withColumn("_within", within).join(shifts, same).select(*df.columns, (F.col("_before") + F.col("_within")).alias(out))


def shard_groups(docs: DataFrame, *, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` of every row: ``shards`` bins of near-equal bytes, or as few
    bins of a fixed ``capacity`` as best fit decreasing needs."""
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_digest"))
    groups = saved(rows.groupBy("_digest").agg(F.sum("size").alias("_bytes")), "shard-groups")
    sizes = [(r["_bytes"], r["n"]) for r in groups.groupBy("_bytes").agg(F.count("*").alias("n")).collect()]
    runs, at, given = (even_packing(sizes, shards) if shards else pack(sizes, capacity)), {}, []
    for size, n, bin_ in runs:
        first = at.get(size, 0)
        given.append((size, first, first + n, bin_))
        at[size] = first + n
    places = spark.createDataFrame(given, "_bytes long, _first long, _last long, shard int")
    whole = places.where("_first = 0").join(groups.groupBy("_bytes").agg(F.count("*").alias("_all")), "_bytes").where("_last = _all")
    easy = groups.join(whole.select("_bytes", "shard"), "_bytes").select("_digest", "shard")  # all groups of the size in one bin
    split = groups.join(whole, "_bytes", "left_anti")
    ranked = rank_within(split, ["_bytes"], [F.col("_digest")], F.pmod(F.xxhash64("_digest"), F.lit(parts)), "_rank")
    hard = ranked.join(places, "_bytes").where("_rank >= _first and _rank < _last").select("_digest", "shard")
    placed = saved(rows.join(easy.unionByName(hard), "_digest").select(id_col, "size", "text_crc32", "shard"), "sharded")
    order = [F.col("size").desc(), F.col(id_col), F.col("text_crc32")]
    return rank_within(placed, ["shard"], order, F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(parts)), "slot")
