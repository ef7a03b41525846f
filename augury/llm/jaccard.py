"""N-gram Jaccard join with token-combination prefixes.

A text's set is its distinct shingles of five words (64-bit hashes). Texts with equal sets become one node,
so copies are never compared. In how many sets each shingle stands is counted over all texts; a shingle's class
is twice the binary logarithm of that number (0: it stands in one set, and cannot link anything). Sets are
ordered by class, then hash: rare shingles first. With threshold t, sets of n shingles and a = ceil(t n), two
linked sets share their first common shingle within the first n - a + 1 of both.

* Rare shingles (class below FREQUENT) are indexed singly. Their lists are short by definition.
* A frequent shingle alone says little, so its list is extended by combinations of further tokens. Lists with a
  leader (the member of smallest hash) in common form a family, and a family gets a centre: the shingles that most
  of a few members have. A member x is then known by its difference D(x) from the centre. With e(x) =
  (1 + t) |D(x)| - (1 - t) |x|, two members are linked exactly if 2 (1 + t) |D(x) & D(y)| >= e(x) + e(y). So

  - all members with e(x) + e(m) <= 0, m being the one of smallest e, are linked with m without a comparison; in a
    group of near copies those are most, and they cost one row each;
  - any other member needs o >= 1 tokens of its difference in common with a partner, and the more the farther both
    are from the centre. Where o is up to SINGLES, or either has less than SINGLES tokens to spare, prefixes of s - o + 1
    tokens are indexed singly; else the tokens are dealt to o - 1 classes, two of those shared fall in one class, and
    each such pair of tokens is indexed. Classes follow the place in the centre, so that the five shingles one
    changed word touches are in different ones and a pair stands for two common changes. Since o depends on both,
    a member signs for each band of e that partners are in, and pairs too far for the tokens they have are left out.

  A list of the second index that is still long is a family again, with a centre of its own.

Short lists are verified pair by pair, where the two are not yet in one component; long ones never are, save what
is left after LEVELS levels. Links are contracted to components, and pairs inside a component need no check, so the
components are exact. Rare lists are first verified against one member each, and this repeats with other members
while it finds links. Verification counts the common shingles of whole sets, or of whole differences.

Scale: texts are read three times and never shuffled. For counting, shingles travel as 32-bit remainders of
their hash range, sorted, delta-coded and packed; signatures of rare shingles as packed arrays cut by hash range.
Families are aggregated before they are joined, hot joins are AQE's to split, and no task holds a family. What is
broadcast has a fixed size, whatever the corpus: the class table (CELLS bytes; shingles that fall in one cell share
the highest class, which costs candidates but loses none) and the filter of nodes that are in any list (FILTER_BITS
bits; one that fills up only lets more sets through to an exact join). Lineage is cut by tables in the shared folder.

Rows: null and empty texts, and texts of white space, have no shingles and are linked with nothing; with fewer
than five words the whole sequence is one shingle; repeated ids and rows keep their rows and share a component
through their texts; a null id keeps a null component unless its text is linked; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices

WORDS = 5
#: Cells of the class table.
CELLS = 1 << 25
#: The class from which signatures are pairs of shingles: those that stand in 128 sets or more.
FREQUENT = 14
FILTER_BITS = 1 << 27
WORD_ENTRIES = 300_000
STAR_ROUNDS = 3
#: Families up to this length are verified pair by pair, and lists of the second index up to eight times of it.
SHORT = 64
#: Levels of centres, members that vote on a centre, bands of e above a centre's own size, tokens indexed singly.
LEVELS, VOTERS, BANDS, SINGLES = 4, 16, 64, 3
#: Links that one task may unite.
TASK_LINKS = 1 << 18
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, n: int = WORDS):
        from xxhash import xxh3_64_intdigest

        self.n, self.hash, self.words = n, xxh3_64_intdigest, {}

    def __call__(self, texts: list[str], ordered: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """The sets; ordered also gets each in the order of the text."""
        split = [t.encode().lower().split() for t in texts]  # ASCII white space, ASCII case
        if len(self.words) > WORD_ENTRIES:
            self.words.clear()
        for w in set().union(*split):
            if w not in self.words:
                self.words[w] = self.hash(w)
        sizes = [len(w) for w in split]
        flat = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.uint64, sum(sizes))
        n, rows = self.n, len(flat) - self.n + 1
        if rows > 0:
            rolled = flat[:rows] * _ODD[0]
            for i in range(1, n):
                rolled = mix(rolled) + flat[i:i + rows] * _ODD[i % 5]
            rolled = mix(rolled)
        out, at = [], 0
        for size in sizes:
            if size >= n:
                found, first = np.unique(rolled[at:at + size - n + 1], return_index=True)
                out.append(found)
                if ordered is not None:
                    ordered.append(found[np.argsort(first)])
            elif size:
                h = np.array([size], np.uint64)
                for i in range(at, at + size):
                    h = mix(h ^ (flat[i:i + 1] * _ODD[3]))
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
            if ordered is not None and size < n:
                ordered.append(out[-1])
            at += size
        return out


def set_key(s: np.ndarray, digest) -> int:
    return digest(s.tobytes()) - (1 << 63)


def cut(s: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash range (the top bits) and the 32 bits below."""
    return (s >> np.uint64(64 - bits)).astype(np.int64), (s >> np.uint64(32 - bits)).astype(np.uint32)


def cells(ranges: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Each range has its own part of the class table."""
    part = CELLS >> bits
    return ranges * part + (mix(low.astype(np.uint64)) % np.uint64(part)).astype(np.int64)


def _sets_and_shingles(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows of two kinds: id, number of shingles and key of each text; and, with a range, packed shingles of a
    task (each distinct set of a task once)."""
    id_type = docs.schema.fields[0].dataType.simpleString()
    names = ["id", "n", "key", "range", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        shingle, seen, waiting, held, kinds = Shingler(n), set(), [], 0, []

        def packed() -> Iterator[pa.RecordBatch]:
            where, low = cut(np.sort(np.concatenate(waiting)), bits)
            ends, rows = np.searchsorted(where, np.arange((1 << bits) + 1)), []
            for r in np.flatnonzero(np.diff(ends)).tolist():
                deltas = np.diff(low[ends[r]:ends[r + 1]], prepend=np.uint32(0))
                rows.append((r, pack(deltas.view(np.uint8).reshape(-1, 4).T.tobytes())))
            for i in range(0, len(rows), 64):
                part = rows[i:i + 64]
                none = [pa.nulls(len(part), k) for k in kinds]
                yield pa.RecordBatch.from_arrays([*none, pa.array([r for r, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], names=names)

        for part in slices(batches):
            kinds = kinds or [part.schema.field(0).type, pa.int64(), pa.int64()]
            sets = shingle([t or "" for t in part.column(1).to_pylist()])
            keys = [set_key(s, shingle.hash) if len(s) else None for s in sets]
            for s, k in zip(sets, keys, strict=True):
                if k is not None and k not in seen:
                    seen.add(k)
                    waiting.append(s)
                    held += len(s)
            if held > 4_000_000:
                yield from packed()
                waiting, held = [], 0
            none = [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), *none], names=names)
        if waiting:
            yield from packed()

    return docs.mapInArrow(run, f"id {id_type}, n long, key long, range int, packed binary")


def _classes(packed: DataFrame, bits: int) -> np.ndarray:
    """The class table: each range's part is filled in one task (CELLS bytes come to the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, low = zstandard.ZstdDecompressor().decompress, {}
        for part in slices(batches, 64):
            for r, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                planes = np.frombuffer(unpack(b), np.uint8).reshape(4, -1)
                low.setdefault(r, []).append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32))
        for r in list(low):
            x = np.sort(np.concatenate(low.pop(r)))
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            counts = np.diff(starts, append=len(x))
            x, counts = x[starts[counts > 1]], counts[counts > 1]
            table = np.zeros(CELLS >> bits, np.uint8)
            np.maximum.at(table, cells(np.zeros(1, np.int64), x, bits), (2 * np.log2(counts)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([zstandard.compress(table.tobytes(), 1)], pa.binary())], names=["range", "classes"])

    import zstandard

    out, part = np.zeros(CELLS, np.uint8), CELLS >> bits
    for r in packed.repartition("range").mapInArrow(run, "range int, classes binary").collect():
        out[r["range"] * part:(r["range"] + 1) * part] = np.frombuffer(zstandard.decompress(r["classes"]), np.uint8)
    return out


def signatures(s: np.ndarray, classes: np.ndarray, percent: int, bits: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The rare and the frequent shingles of a set's prefix."""
    n = len(s)
    power = classes[cells(*cut(s, bits), bits)]
    first = np.lexsort((s, power))[:n - -(-percent * n // 100) + 1]
    s, power = s[first], power[first]
    return s[(power > 0) & (power < frequent)], s[power >= frequent]


def _lists(docs: DataFrame, classes, n: int, percent: int, bits: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """``sig, key, n``: members of every list of two sets or more, for rare shingles and for frequent ones."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, table = Shingler(n), set(), np.frombuffer(classes.value, np.uint8)
        names = ["range", "sigs", "keys", "sizes"]

        def packed(rare: list, pairs: list) -> Iterator[pa.RecordBatch]:
            rows = []
            for found, paired in ((rare, False), (pairs, True)):
                if not found:
                    continue
                sig = np.concatenate([x for x, _, _ in found])
                counts = [len(x) for x, _, _ in found]
                key, size = np.repeat(np.array([k for _, k, _ in found], np.int64), counts), np.repeat(np.array([m for _, _, m in found], np.int32), counts)
                where = cut(sig, bits)[0]
                order = np.argsort(where, kind="stable")
                sig, key, size, where = sig[order], key[order], size[order], where[order]
                cuts = np.flatnonzero(np.diff(where)) + 1
                for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sig)], strict=True):
                    if end > at:
                        rows.append((-1 - int(where[at]) if paired else int(where[at]), sig[at:end].tobytes(), key[at:end].tobytes(), size[at:end].tobytes()))
            for i in range(0, len(rows), 64):
                cols = list(zip(*rows[i:i + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)

        rare, pairs, held = [], [], 0
        for part in slices(batches):
            for s in shingle([t or "" for t in part.column(0).to_pylist()]):
                if len(s) and (k := set_key(s, shingle.hash)) not in seen:
                    seen.add(k)
                    single, paired = signatures(s, table, percent, bits, frequent)
                    if len(single):
                        rare.append((single, k, len(s)))
                    if len(paired):
                        pairs.append((paired, k, len(s)))
                    held += len(single) + len(paired)
            if held > 2_000_000:
                yield from packed(rare, pairs)
                rare, pairs, held = [], [], 0
        yield from packed(rare, pairs)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[bytes]] = [[], [], []]
        for part in batches:
            for have, c in zip(cols, part.columns, strict=True):
                have += c.to_pylist()
        sig, key, size = (np.frombuffer(b"".join(c), t) for c, t in zip(cols, (np.uint64, np.int64, np.int32), strict=True))
        order = np.lexsort((key, sig))
        sig, key, size = sig[order], key[order], size[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key, size = sig[new], key[new], size[new]
        if not len(sig):
            return
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        counts = np.diff(starts, append=len(sig))
        marks = np.add.reduceat(mix(key.view(np.uint64)), starts) ^ mix(counts.astype(np.uint64))  # the same for lists with the same members
        keep = np.flatnonzero(counts > 1)
        keep = keep[np.unique(marks[keep], return_index=True)[1]]
        at = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in keep]) if len(keep) else np.zeros(0, np.int64)
        mark = np.repeat(marks[keep], counts[keep]).view(np.int64)
        for i in range(0, len(at), 50_000):
            j = at[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(mark[i:i + 50_000]), pa.array(key[j]), pa.array(size[j])], names=["sig", "key", "n"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            arrays = [np.frombuffer(part.column(i)[0].as_py(), t) for i, t in ((0, np.int64), (1, np.int64), (2, np.int32))]
            for i in range(0, len(arrays[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[i:i + 50_000]) for a in arrays], names=["sig", "key", "n"])

    packs = saved(docs.select("text").mapInArrow(sign, "range int, sigs binary, keys binary, sizes binary"), "signatures")
    schema = "sig long, key long, n int"
    rare = packs.where("range >= 0").repartition("range").select("sigs", "keys", "sizes").mapInArrow(gather, schema).distinct()
    often = packs.where("range < 0").select("sigs", "keys", "sizes").mapInArrow(unpacked, schema).distinct()
    return saved(rare, "rare-lists"), saved(often, "frequent-lists")


def _bits(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _sets_of(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``key, shingles`` (in the order of the text) of the sets in keys, each once. keys go through a filter of
    FILTER_BITS bits."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at = _bits(part.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["w", "b"])

    words = np.zeros(FILTER_BITS // 32, np.uint32)
    found = keys.select("key").mapInArrow(mark, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # FILTER_BITS / 32 rows at most
    words[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    wanted = docs.sparkSession.sparkContext.broadcast(words.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, bits = Shingler(n), set(), np.frombuffer(wanted.value, np.uint32)
        for part in slices(batches):
            told: list[np.ndarray] = []
            own = np.array([set_key(s, shingle.hash) for s in shingle([t or "" for t in part.column(0).to_pylist()], told) if len(s)], np.int64)
            sets = [s for s in told if len(s)]
            at = _bits(own)
            hit = (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            rows = [(k, s.tobytes()) for k, s, h in zip(own.tolist(), sets, hit.tolist(), strict=True) if h and k not in seen and not seen.add(k)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], names=["key", "shingles"])

    sets = docs.select("text").mapInArrow(run, "key long, shingles binary")
    return saved(sets.join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            cols, keep = part.to_pydict(), []
            for i, (x, y) in enumerate(zip(cols["x"], cols["y"], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int32())), part.column(1).take(pa.array(keep, pa.int32()))], names=["a", "b"])

    both = pairs.join(sets.selectExpr("key a", "shingles x"), "a").join(sets.selectExpr("key b", "shingles y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for part in batches:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    keys = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([root(k) for k in keys], pa.int64())], names=["key", "comp"])


def components(links: DataFrame) -> DataFrame:
    """``key, comp``: each key in a link with the smallest key of its component. Up to TASK_LINKS links (16 bytes
    each; they are counted first) one task unites them; beyond it, alternating large and small stars until
    nothing changes."""
    if links.limit(TASK_LINKS + 1).count() <= TASK_LINKS:
        return links.select("a", "b").coalesce(1).mapInArrow(_united, "key long, comp long")
    edges, before = links.selectExpr("greatest(a, b) u", "least(a, b) v").where("u <> v").distinct(), None
    while True:
        both = edges.unionByName(edges.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v u", "m v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v u", "m v").unionByName(low.selectExpr("u", "m v")).where("u <> v").distinct()
        edges = saved(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges.selectExpr("u key", "v comp").unionByName(edges.selectExpr("v key", "v comp")).distinct()
        before = now


def _compatible(x: str, y: str, percent: int):
    return F.expr(f"100L * least({x}, {y}) >= {percent}L * greatest({x}, {y})")


def _families(lists: DataFrame) -> DataFrame:
    """``leader, key, n``: the members of all lists whose leaders lead to one. A list's leader is its member of
    smallest hash; it passes on to the least leader that any member has in another list."""
    low = lambda c: F.min(F.struct(F.xxhash64(c, F.lit(11)).alias("h"), F.col(c).alias("k")))
    led = lists.groupBy("sig").agg(low("key")["k"].alias("leader"), F.count("*").alias("m")).where("m > 1").select("sig", "leader")
    best = lists.join(led, "sig").groupBy("key").agg(low("leader")["k"].alias("leader"))
    led = lists.join(best, "key").groupBy("sig").agg(low("leader")["k"].alias("leader"), F.count("*").alias("m")).where("m > 1").select("sig", "leader")
    return saved(lists.join(led, "sig").select("leader", "key", "n").distinct(), "families")


def _centres(families: DataFrame, sets: DataFrame) -> DataFrame:
    """``leader, centre``: the shingles that more than half of at most VOTERS members have, in the order of a text."""
    bucket = F.pmod(F.xxhash64("key", F.lit(13)), F.lit(VOTERS))
    voters = families.groupBy("leader", bucket.alias("b")).agg(F.min(F.struct(F.xxhash64("key", F.lit(17)), "key"))["key"].alias("key"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            votes: list[bytes] = part.column(1)[0].as_py()
            told = np.frombuffer(b"".join(votes), np.uint64)
            found, first, count = np.unique(told, return_index=True, return_counts=True)
            most = 2 * count > len(votes)
            centre = found[most][np.argsort(first[most])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([centre.tobytes()], pa.binary())], names=["leader", "centre"])

    ballots = voters.join(sets, "key").groupBy("leader").agg(F.array_sort(F.collect_list("shingles")).alias("votes"))  # VOTERS sets at most
    return ballots.mapInArrow(vote, "leader long, centre binary")


def _differences(families: DataFrame, sets: DataFrame, classes, percent: int, bits: int) -> DataFrame:
    """``leader, key, n, e, band, tokens, places``: each member as what it differs in from the centre. tokens are
    those that another set may have, in one order for the whole family; places deal them to classes."""
    schema = "leader long, key long, n int, e long, band int, step int, tokens binary, places binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, names = np.frombuffer(classes.value, np.uint8), None, ["leader", "key", "n", "e", "band", "step", "tokens", "places"]
        for part in slices(batches, 64):
            rows = []
            for leader, key, n, own, told in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if leader != last:
                    last, centre = leader, np.frombuffer(told, np.uint64)
                    order = np.argsort(centre)
                    rising, step = centre[order], max(1, len(centre) // (2 * BANDS))
                own = np.frombuffer(own, np.uint64)
                at = np.minimum(np.searchsorted(rising, own), max(len(rising) - 1, 0))
                inside = rising[at] == own if len(rising) else np.zeros(len(own), bool)
                lacks = np.ones(len(centre), bool)
                lacks[order[at[inside]]] = False
                lacks, more = np.flatnonzero(lacks), own[~inside]
                e = (100 + percent) * (len(lacks) + len(more)) - (100 - percent) * n
                power = table[cells(*cut(more, bits), bits)]
                more, power = more[power > 0], power[power > 0]
                more = more[np.lexsort((more, power))]
                lacks = lacks[np.argsort(mix(centre[lacks]))]
                places = np.concatenate([(more >> np.uint64(33)).astype(np.int64), lacks])
                rows.append((leader, key, n, e, min(e // (2 * (100 + percent) * step), BANDS), step, np.concatenate([more, centre[lacks]]).tobytes(), places.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)

    given = families.join(sets, "key").join(_centres(families, sets), "leader").select("leader", "key", "n", "shingles", "centre")
    return saved(given.mapInArrow(run, schema), "differences")


def combinations(tokens: np.ndarray, places: np.ndarray, need: int, single: bool) -> np.ndarray:
    """What sets that share ``need`` tokens are sure to have in common: single tokens of a prefix, or pairs of tokens
    in one of need - 1 classes (need being 2 or more)."""
    if len(tokens) < need:
        return tokens[:0]
    if single:
        return mix(tokens[:len(tokens) - need + 1])
    group = places % (need - 1)
    order = np.lexsort((tokens, group))
    t, group = tokens[order], group[order]
    ends, out = np.searchsorted(group, group, side="right"), [tokens[:0]]
    for i in range(len(t) - 1):
        if ends[i] > i + 1:
            out.append(mix(t[i:i + 1] * _ODD[0] + mix(t[i + 1:ends[i]] + _ODD[1])))
    return np.concatenate(out)


def _second_lists(far: DataFrame) -> DataFrame:
    """``sig, leader, key, n, e, s, comp, far``: members of the lists of token combinations. far has the differences
    with the bands (all, and those with members off the centre) of their family and the most tokens in each."""
    schema = "sig long, leader long, key long, n int, e long, s int, comp long, far boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sig", "leader", "key", "n", "e", "s", "comp", "far"]
        for part in slices(batches, 64):
            sigs, counts = [], []
            for leader, band, step, off, bands, off_bands, tokens, places in zip(*(part.column(c).to_pylist() for c in ("leader", "band", "step", "far", "bands", "far_bands", "tokens", "places")), strict=True):
                bands, off_bands = ({x["band"]: x["most"] for x in b} for b in (bands, off_bands))
                tokens, places, found = np.frombuffer(tokens, np.uint64), np.frombuffer(places, np.int64), []
                for other, most in (bands if off else off_bands).items():
                    need = max(1, step * (band + other))
                    if most < need:
                        continue
                    few = min(bands[band], bands[other]) - need < SINGLES
                    found.append(combinations(tokens, places, need, few or need <= SINGLES))
                salt = mix(np.array([leader & ((1 << 64) - 1)], np.uint64))
                found = np.unique(np.concatenate(found)) ^ salt if found else tokens[:0]
                sigs.append(found)
                counts.append(len(found))
            at = pa.array(np.repeat(np.arange(part.num_rows), counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), *(part.column(c).take(at) for c in names[1:])], names=names)

    return far.mapInArrow(run, schema)


def _shared(pairs: DataFrame, facts: DataFrame, on: list[str], percent: int) -> DataFrame:
    """pairs (leader, a, b) whose differences have enough in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            cols, keep = part.to_pydict(), []
            for i, (x, y, e) in enumerate(zip(cols["x"], cols["y"], cols["e"], strict=True)):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                if 2 * (100 + percent) * common >= e:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(keep, pa.int32())) for c in (0, 1)], names=["a", "b"])

    both = pairs.join(facts.selectExpr("leader", "key a", "tokens x", "e ex"), ["leader", "a"]).join(facts.selectExpr("leader", "key b", "tokens y", "e ey"), ["leader", "b"])
    return both.selectExpr("a", "b", "ex + ey e", "x", "y").mapInArrow(run, "a long, b long")


class _Links:
    """Links found so far and the components they make."""

    def __init__(self, spark):
        self.links, self.comp = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "key long, comp long")

    def add(self, found: DataFrame) -> bool:
        if found.isEmpty():
            return False
        self.links = self.links.unionByName(found)
        self.comp = saved(components(self.links), "components")
        return True

    def placed(self, df: DataFrame) -> DataFrame:
        return df.join(self.comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def _pairs_within(lists: DataFrame, on: str, percent: int) -> DataFrame:
    """``on, a, b``: pairs of one list that are in different components and not too different in size."""
    other = lists.selectExpr(on, "key key2", "n n2", "comp comp2")
    return lists.join(other, on).where("key < key2 and comp <> comp2").where(_compatible("n", "n2", percent)).selectExpr(on, "key a", "key2 b")


def _link_rare(lists: DataFrame, sets: DataFrame, found: _Links, percent: int) -> None:
    """Lists of rare shingles, each shorter than a frequent shingle's: against one member while that finds links,
    then pair by pair."""
    tried, turn, exact = None, 0, False
    while not exact:
        exact = turn >= STAR_ROUNDS
        open_ = found.placed(lists)
        if exact:
            many = open_.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
            pairs = _pairs_within(open_.join(many.select("sig"), "sig", "left_semi"), "sig", percent).select("a", "b").distinct()
        else:
            centre = F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key", "n", "comp")).alias("c")
            many = open_.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), centre).where("lo < hi")
            pairs = open_.join(many.select("sig", "c"), "sig").where("comp <> c.comp").where(_compatible("n", "c.n", percent)).selectExpr("least(key, c.key) a", "greatest(key, c.key) b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        turn = turn + 1 if found.add(saved(_verify(pairs, sets, percent), "links")) else STAR_ROUNDS


def _near_centres(families: DataFrame, sets: DataFrame, classes, found: _Links, percent: int, bits: int, short: int) -> tuple[DataFrame, DataFrame] | None:
    """Links of a family's members near its centre; the differences, and the families that have members off it."""
    sized = families.groupBy("leader").agg(F.count("*").alias("m"))
    long = families.join(sized.where(F.col("m") > short).select("leader"), "leader", "left_semi")
    if long.isEmpty():
        return None
    facts = _differences(long, sets, classes, percent, bits)
    nearest = facts.groupBy("leader").agg(F.min(F.struct("e", "key")).alias("c"))
    told = facts.join(nearest, "leader").withColumn("far", F.expr("e + c.e > 0"))
    found.add(saved(told.where("not far and key <> c.key").selectExpr("least(key, c.key) a", "greatest(key, c.key) b").distinct(), "links"))
    most = told.groupBy("leader", "band").agg(F.max(F.octet_length("tokens") / 8).cast("int").alias("most"), F.max(F.when(F.col("far"), F.octet_length("tokens") / 8)).cast("int").alias("far_most"), F.first("c").alias("c"))
    listed = lambda c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct("band", F.col(c).alias("most"))))
    bands = most.groupBy("leader").agg(listed("most").alias("bands"), listed("far_most").alias("far_bands"), F.first("c").alias("c")).where("size(far_bands) > 0")
    return facts, saved(bands, "bands")


def _link_frequent(often: DataFrame, sets: DataFrame, classes, rare: DataFrame, found: _Links, percent: int, bits: int, short: int) -> None:
    """Families of frequent shingles, level by level; the rare lists come in once the near copies are contracted."""
    families = _families(often)
    for level in range(LEVELS):
        near = _near_centres(families, sets, classes, found, percent, bits, short)
        if level == 0:
            _link_rare(rare, sets, found, percent)
        placed = found.placed(families)
        sized = placed.groupBy("leader").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        some = placed.join(sized.where(F.col("m") <= short).select("leader"), "leader", "left_semi")
        pairs = _pairs_within(some, "leader", percent).select("a", "b").distinct()
        found.add(saved(_verify(pairs, sets, percent), "links"))
        if near is None:
            return
        facts, bands = near
        members = found.placed(facts).join(bands, "leader").withColumns({"far": F.expr("e + c.e > 0"), "s": F.expr("int(octet_length(tokens) / 8)")})
        lists = saved(_second_lists(members), "combinations")
        many = lists.groupBy("sig").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("far").alias("any"), F.bit_xor(F.xxhash64("key")).alias("x"), F.first("leader").alias("leader"))
        many = saved(many.where("lo < hi and any").groupBy("leader", "m", "x").agg(F.min("sig").alias("sig")), "open")  # lists with the same members are one
        last = level == LEVELS - 1
        brief = many if last else many.where(F.col("m") <= 8 * short)
        some = lists.join(brief.select("sig"), "sig", "left_semi")
        other = some.selectExpr("sig", "key key2", "n n2", "comp comp2", "far far2", "e e2", "s s2")
        enough = f"e + e2 <= {2 * (100 + percent)} * least(s, s2)"
        pairs = some.join(other, "sig").where(f"key < key2 and comp <> comp2 and (far or far2) and {enough}").where(_compatible("n", "n2", percent)).selectExpr("leader", "key a", "key2 b").distinct()
        found.add(saved(_shared(pairs, facts, ["leader"], percent), "links"))
        if last:
            return
        families = saved(lists.join(many.where(F.col("m") > 8 * short).select("sig"), "sig", "left_semi").selectExpr("sig leader", "key", "n"), "families")
        if families.isEmpty():
            return


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75,
                    frequent: int = FREQUENT, short: int = SHORT) -> DataFrame:
    """``id_col, n_shingles, key, component_id`` of every row: key names the set (null without shingles),
    component_id is the smallest id that links reach."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bits = min(20, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length()))
    made = saved(_sets_and_shingles(texts, words, bits), "keys")
    keyed = made.where("range is null").select("id", "n", "key")
    table = _classes(made.where("range is not null").select("range", "packed"), bits)
    classes = spark.sparkContext.broadcast(table.tobytes())
    rare, often = _lists(texts, classes, words, percent, bits, frequent)
    found = _Links(spark)
    listed = rare.select("key").unionByName(often.select("key")).distinct()
    if not listed.isEmpty():
        sets = _sets_of(texts, listed, words)
        _link_frequent(often, sets, classes, rare, found, percent, bits, short)
    lowest = keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("id"))
    placed = found.placed(lowest)
    names = placed.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = placed.join(names, "comp").select("key", "component_id")
    out = keyed.join(named, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "key", F.coalesce("component_id", "id").alias("component_id"))
