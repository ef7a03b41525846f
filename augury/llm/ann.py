"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node that keeps the ``k + 1`` smallest ids, all that a result of k neighbours without
the query's own id can hold. Nodes are dealt to shards by a hash of the vector, about ``shard_rows`` each. A
shard's graph is built in one task and stored as flat arrays: vectors, neighbours of level 0 (``2 m`` a node,
-1 where none), and for the levels above which nodes are there and their ``m`` neighbours. Queries, in blocks,
meet every shard's stored graph once; each shard gives its k nearest, measured exactly in double precision, and
these are merged.

Scale: a task holds one shard and one block of queries, both of bounded size; nothing is broadcast or
collected. A shard is written to the shared folder before it is searched, so a lost executor costs a read. An
exhaustive scan stands in for a shard of at most ``ef`` nodes, and where a search comes back with fewer than k.

Rows: vectors that are null, empty, all zero or hold null or non-finite components take no part; vectors of
another length are searched among themselves; ties go to the smaller id; a repeated row (same id and vector)
counts once; with fewer than k candidates all are returned; null ids take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

M, EF_BUILD, EF_SEARCH = 16, 80, 128


class Graph:
    """Flat arrays: base[n, 2m] neighbours at level 0; tops[i] = (nodes, neighbours[len(nodes), m]) at level i + 1."""

    def __init__(self, vectors: np.ndarray, base: np.ndarray, tops: list[tuple[np.ndarray, np.ndarray]], entry: int):
        self.vectors, self.base, self.tops, self.entry = vectors, base, tops, entry
        self.fast, self.square = vectors.astype(np.float32), (vectors.astype(np.float32) ** 2).sum(1)
        self.rows = [{int(n): i for i, n in enumerate(nodes)} for nodes, _ in tops]
        self.seen, self.turn = np.zeros(len(vectors), np.int64), 0

    def near(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances less the constant q.q."""
        return self.square[ids] - 2.0 * (self.fast[ids] @ q)

    def neighbours(self, node: int, level: int) -> np.ndarray:
        got = self.base[node] if level == 0 else self.tops[level - 1][1][self.rows[level - 1][node]]
        return got[got >= 0]

    def climb(self, q: np.ndarray, at: int, level: int) -> int:
        """The nearest node that greedy steps reach on a level."""
        best = float(self.near(q, np.array([at]))[0])
        while True:
            ids = self.neighbours(at, level)
            if not len(ids):
                return at
            d = self.near(q, ids)
            i = int(d.argmin())
            if d[i] >= best:
                return at
            at, best = int(ids[i]), float(d[i])

    def search(self, q: np.ndarray, entry: int, ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest that a best-first search finds, nearest first."""
        self.turn += 1
        first = float(self.near(q, np.array([entry]))[0])
        todo, found = [(first, entry)], [(-first, entry)]
        self.seen[entry] = self.turn
        while todo:
            d, node = heapq.heappop(todo)
            if d > -found[0][0] and len(found) >= ef:
                break
            ids = self.neighbours(node, level)
            ids = ids[self.seen[ids] != self.turn]
            if not len(ids):
                continue
            self.seen[ids] = self.turn
            for x, i in zip(self.near(q, ids).tolist(), ids.tolist(), strict=True):
                if len(found) < ef:
                    heapq.heappush(found, (-x, i))
                    heapq.heappush(todo, (x, i))
                elif x < -found[0][0]:
                    heapq.heapreplace(found, (-x, i))
                    heapq.heappush(todo, (x, i))
        return sorted((-x, i) for x, i in found)

    def candidates(self, q: np.ndarray, ef: int) -> np.ndarray:
        if len(self.vectors) <= ef:
            return np.arange(len(self.vectors))
        q, at = q.astype(np.float32), self.entry
        for level in range(len(self.tops), 0, -1):
            at = self.climb(q, at, level)
        return np.array([i for _, i in self.search(q, at, ef, 0)])


def build(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 5) -> Graph:
    """Nodes enter one by one; each links to its nearest found so far, and full nodes keep their nearest that
    aren't closer to a neighbour kept before (so that clusters stay joined)."""
    n, rng = len(vectors), np.random.default_rng(seed)
    levels = np.minimum((-np.log(rng.uniform(1e-12, 1, n)) / np.log(m)).astype(int), 6)
    tops = [(np.flatnonzero(levels >= k), np.full((int((levels >= k).sum()), m), -1, np.int32)) for k in range(1, int(levels.max(initial=0)) + 1)]
    g = Graph(vectors, np.full((n, 2 * m), -1, np.int32), tops, 0)
    top = int(levels[0]) if n else 0

    def slots(node: int, level: int) -> np.ndarray:
        return g.base[node] if level == 0 else g.tops[level - 1][1][g.rows[level - 1][node]]

    def spread(node: int, ids: np.ndarray, most: int) -> np.ndarray:
        d = g.near(g.fast[node], ids)
        order = np.argsort(d, kind="stable")
        ids, d = ids[order], d[order] + g.square[node]
        own = g.square[ids][:, None] + g.square[ids][None] - 2 * g.fast[ids] @ g.fast[ids].T
        kept: list[int] = []
        for i in range(len(ids)):
            if len(kept) < most and (not kept or own[i, kept].min() > d[i]):
                kept.append(i)
        rest = [i for i in range(len(ids)) if i not in set(kept)]
        return ids[(kept + rest)[:most]]

    for node in range(1, n):
        q, at = g.fast[node], g.entry
        for level in range(top, int(levels[node]), -1):
            at = g.climb(q, at, level)
        for level in range(min(top, int(levels[node])), -1, -1):
            found = g.search(q, at, ef, level)
            at = found[0][1]
            own = spread(node, np.array([i for _, i in found[: 2 * m]]), m)
            slots(node, level)[:len(own)] = own
            for other in own.tolist():
                s = slots(other, level)
                free = np.flatnonzero(s < 0)
                if len(free):
                    s[free[0]] = node
                else:
                    s[:] = spread(other, np.append(s, node), len(s))
        if levels[node] > top:
            top, g.entry = int(levels[node]), node
    return g


def _clean(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Usable vectors as float64 bytes; those of a batch with equal vectors in one row with their smallest ids."""
    for batch in batches:
        ids: dict[bytes, set[int]] = {}
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not v or None in v:
                continue
            a = np.array(v, np.float64) + 0.0  # no negative zeros: equal vectors have equal bytes
            if np.isfinite(a).all() and a.any():
                ids.setdefault(a.tobytes(), set()).add(i)
        rows = [(k, sorted(s)[:most]) for k, s in ids.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], names=["vec", "ids"])


def _build_shard(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    merged: dict[bytes, set[int]] = {}
    for vec, ids in zip(rows["vec"], rows["ids"], strict=True):
        merged.setdefault(bytes(vec), set()).update(map(int, ids))
    order = sorted(merged)
    vectors = np.frombuffer(b"".join(order), np.float64).reshape(len(order), -1)
    g = build(vectors)
    ids = [sorted(merged[k])[:most] for k in order]
    return pd.DataFrame({
        "dim": [vectors.shape[1]], "shard": [int(rows["shard"].iloc[0])], "vectors": [vectors.tobytes()], "base": [g.base.tobytes()], "entry": [g.entry],
        "top_nodes": [[n.astype(np.int32).tobytes() for n, _ in g.tops]], "top_links": [[t.tobytes() for _, t in g.tops]],
        "ids": [np.array([i for x in ids for i in x], np.int64).tobytes()], "counts": [np.array([len(x) for x in ids], np.int32).tobytes()],
    })


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192, query_rows: int = 4096, ef: int = EF_SEARCH) -> DataFrame:
    """``query_id, rank, <id>, score``: of each row for which ``is_query`` (a condition on its id) holds, the k
    nearest found among all other ids, by Euclidean distance."""
    most, parts = k + 1, max(1, -(-vectors.count() // shard_rows))
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(lambda b: _clean(b, most), "vec binary, ids array<long>")
    placed = clean.withColumns({"dim": F.octet_length("vec") / 8, "shard": F.pmod(F.xxhash64("vec"), F.lit(parts)).cast("int")}).withColumn("dim", F.col("dim").cast("int"))
    index_type = "dim int, shard int, vectors binary, base binary, entry int, top_nodes array<binary>, top_links array<binary>, ids binary, counts binary"
    index = saved(placed.groupBy("dim", "shard").applyInPandas(lambda rows: _build_shard(rows, most), index_type), "hnsw")
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(lambda b: _clean(b, 1 << 30), "vec binary, ids array<long>")
    asked = asked.select((F.octet_length("vec") / 8).cast("int").alias("dim"), "vec", F.explode("ids").alias("query_id")).distinct()
    blocks = max(1, -(-vectors.where(is_query).count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "vec"), F.lit(blocks)))
    asked = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "vec")).alias("queries")).select("dim", "block", F.col("queries.query_id").alias("query_ids"), F.col("queries.vec").alias("query_vecs"))
    pairs = asked.join(index, "dim")  # blocks x shards of one dimension: every query has to meet every shard
    names = [*index.columns, "query_ids", "query_vecs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim, own = r["dim"], np.frombuffer
                vecs, counts = own(r["vectors"], np.float64).reshape(-1, dim), own(r["counts"], np.int32)
                tops = [(own(n, np.int32), own(t, np.int32).reshape(-1, M)) for n, t in zip(r["top_nodes"], r["top_links"], strict=True)]
                g, ids = Graph(vecs, own(r["base"], np.int32).reshape(-1, 2 * M), tops, r["entry"]), own(r["ids"], np.int64)
                begins = np.cumsum(counts) - counts
                rows: list[tuple[int, int, float]] = []
                for qid, raw in zip(r["query_ids"], r["query_vecs"], strict=True):
                    q = own(raw, np.float64)
                    nodes = g.candidates(q, ef)
                    for _ in range(2):
                        d = np.sqrt(((vecs[nodes] - q) ** 2).sum(1))
                        got = [(float(x), int(i)) for x, n in zip(d, nodes, strict=True) for i in ids[begins[n]:begins[n] + counts[n]] if i != qid]
                        if len(got) >= k or len(nodes) == len(vecs):
                            break
                        nodes = np.arange(len(vecs))
                    rows += [(qid, i, x) for x, i in heapq.nsmallest(k, got)]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "id", "score"])

    found = pairs.select(*names).repartition("query_ids", "shard").mapInArrow(run, "query_id long, id long, score double")
    best = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
