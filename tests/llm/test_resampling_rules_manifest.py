"""Importance resampling, adaptive quality rules and the Merkle manifest against plain Python, with edge cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from augury.llm import manifest, quality_rules, resampling

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, n int, tree string, score string, rank string, words string, at string"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeats."""
    rng = random.Random(11)
    say = lambda n, k=30: " ".join(rng.choice([f"W{i}", f"wö{i}", f"x-{i}"]) for i in (rng.randrange(k) for _ in range(n)))
    long = say(90000, 5000)
    texts = [None, "", " \n\t ", "one", "two words", say(25), say(60), long, "same line\n" * 40 + say(60), "# $ % & " * 30 + say(60), say(60, 3), say(80), say(200), "\x0b\f\r" + say(55)]
    rows = [(i, t, rng.choice(["de", "en", None]), rng.choice(["a", "b", None]), rng.choice([None, len(t or "")])) for i, t in enumerate(texts)]
    rows += [(None, say(70), None, None, None), (None, say(30), "en", "a", 3), (5, texts[5], "en", "a", 3), (5, say(40), "en", "a", 3), (6, texts[6], "fr", "ä", 1), (6, texts[6], "fr", "ä", 1)]
    rows += [(100 + i, say(90 + i), "en", "hot", 7) for i in range(150)]
    return [(*r, 1, 2, "x", "s", None, "w", "a") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def ascii_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute_resample(rows, target, percent=5):
    def buckets(text):
        w = ascii_words(text)
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    docs = [(i, *buckets(t)) for i, t in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in target for b in buckets(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(able[:len(able) * percent // 100], 1):
        r[5] = k
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("percent", [0, 5, 60, 100])
def test_resampling(spark, odd, percent):
    target = ["w1 w2 w3 W1", None, "", "wö1 wö2 wö3 x 1"]
    got = resampling.resample(odd, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, got.collect()))) == brute_resample([r[:2] for r in odd_rows()], target, percent)


def test_resampling_of_empty_tables_and_other_ids(spark, odd):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(odd.limit(0), none).collect() == []
    got = resampling.resample(odd.select("doc_id", "text"), none)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute_resample([r[:2] for r in odd_rows()], [])
    named = spark.createDataFrame([("a", "x y"), ("b", None)], "key string, body string")
    got = {r["key"]: r for r in resampling.resample(named, none, id_col="key", text_col="body", n=2, min_words=1, percent=100).collect()}
    assert got["a"]["n_features"] == 3 and got["a"]["rank"] == 1 and got["b"]["weight"] == 0 and got["b"]["rank"] is None


def test_long_texts_are_hashed_in_runs(monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(101)).encode()
    whole = [sorted(int(b) for p in resampling.feature_buckets(text, 3, 10000)[1] for b in p)]
    for run in (1, 2, 3, 7, 100, 101):
        monkeypatch.setattr(resampling, "RUN", run)
        whole.append(sorted(int(b) for p in resampling.feature_buckets(text, 3, 10000)[1] for b in p))
    assert all(w == whole[0] for w in whole) and len(whole[0]) == 101 + 100 + 99


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if n[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


def test_quality_rules(odd):
    rows = [(r[0], r[2], r[3], *brute_counts(r[1])) for r in odd_rows()]
    share = lambda k, of, by=1000: by * k // of if of else 0
    failed = lambda r: r[3] < 50 or 100 * r[7] > 50 * r[3]
    values = lambda r: {"word_length": share(r[4], r[3], 100), "symbol_share": share(r[5], r[4]), "line_share": share(r[6], r[8]), "repeat_share": share(r[7], r[3])}
    binned = lambda v: v - v % (1 << max(v.bit_length() - 6, 0))
    good = [r for r in rows if not failed(r)]

    def fence(r, m):
        for group in ([g for g in good if g[1:3] == r[1:3]], [g for g in good if g[1] == r[1]], good):
            if len(group) >= 100 or group is good:
                v = sorted(binned(values(g)[m]) for g in group)
                q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
                span = 3 * max(q3 - q1, quality_rules.LEAST[m])
                return (q1 - span if m == "word_length" else 0), q3 + span

    kept = lambda r: not failed(r) and all(fence(r, m)[0] <= v <= fence(r, m)[1] for m, v in values(r).items())
    want = sorted(repr((r[0], *r[3:8], failed(r), kept(r))) for r in rows)
    got = quality_rules.judge(odd)
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()) == want
    assert 0 < sum(map(kept, rows)) < len(good)
    assert quality_rules.judge(odd.limit(0)).collect() == []


def test_sketches_merge_to_the_whole(odd):
    rows = quality_rules.measured(odd)
    whole = {tuple(r) for r in quality_rules.sketch(rows, []).collect()}
    parts = quality_rules.sketch(rows, ["lang", "source"])
    assert {tuple(r) for r in quality_rules.merged(quality_rules.merged(parts, ["lang"]), []).collect()} == whole
    assert all(v - v / 32 <= b <= v for v, b in rows.sparkSession.range(5000).select("id", quality_rules.bin_of(F.col("id"))).collect())


def brute_manifest(rows, arity=2):
    """Leaves, proofs and folds of (doc_id, text, lang, source, n_chars) rows."""
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: H(field(r[0]), field(r[3]), field(r[2]), field(n), field(r[1]))

    def proofs(nodes):
        """The top, and of each node its siblings as (before, after) at every level."""
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
            for k, w in enumerate(where):
                run, s = runs[w // arity], w % arity
                paths[k].append(("".join(run[:s]), "".join(run[s + 1:])))
            nodes, where = [H(*r) for r in runs], [w // arity for w in where]
        return nodes[0] if nodes else None, paths

    langs = {}
    for r in rows:
        change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, r[4] + 1) if change else None))
    tops = []
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        langs[lang].sort(key=lambda x: x[:3])
        tops.append((lang, *proofs([x[2] for x in langs[lang]])))
    root, onward = proofs([t[1] for t in tops])
    out = []
    for (lang, subroot, paths), more in zip(tops, onward, strict=True):
        for x, path in zip(langs[lang], paths, strict=True):
            cur = x[3] or x[2]
            for before, after in path + more:
                cur = H(before, cur, after)
            out.append(repr((x[1] if x[0] else None, x[2], subroot, root, H(*(b + a for b, a in path + more)), cur, cur == root)))
    return sorted(out)


def proved(df, arity=2):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, [*fields[:3], F.col("n_chars") + 1, fields[4]])
    found = manifest.build(df, fields, group=F.col("lang"), id_col="doc_id", changed=changed, arity=arity)
    told = found.select("id", "leaf", "subroot", "root", F.sha2(manifest.siblings(), 256), manifest.fold(F.coalesce("changed", "leaf")).alias("folded"))
    return sorted(repr(tuple(r)) for r in told.withColumn("verified", F.col("folded") == F.col("root")).collect())


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest(odd, arity):
    assert proved(odd, arity) == brute_manifest(odd_rows(), arity)


@pytest.mark.parametrize("sizes", [[], [1], [2], [1, 1], [33, 1], [32], [64, 31], [65, 1, 1], [1025]])
def test_manifest_of_sizes(spark, sizes):
    rows = [(i * 977 % 7919, f"t{i}", f"l{k}", None, i) for k, n in enumerate(sizes) for i in range(n)]
    assert proved(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")) == brute_manifest(rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_resampling", "op12_quality_rules", "op13_merkle_manifest"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    said = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in said.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in said.fetchall())


def test_ranks_by_sort(spark):
    """Against plain sorting, with a key that holds most rows, null keys, ties and descending order."""
    from augury.llm.common import ranked_by_sort

    rng = random.Random(4)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.randrange(40), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    got = ranked_by_sort(df, ["k"], [F.desc("v"), F.col("i")], "r", "test", "n").collect()
    want = {}
    for k, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        want.setdefault(k, []).append(i)
    assert len(got) == len(rows) and all(want[r["k"]][r["r"]] == r["i"] and r["n"] == len(want[r["k"]]) for r in got)
    assert ranked_by_sort(df.limit(0), ["k"], [F.col("v")], "r", "test").collect() == []


def test_one_thread_of_many_answers(spark):
    """All answer the first turn: one root, whose rows no task has to hold; positions stay gapless and in order."""
    from augury.llm import chat

    rows = [(1, 0, "user", "the first words")] + [(1, i, "user", f"> the first words\nanswer {i}") for i in range(1, 300)] + [(None, 0, "user", "x"), (2, None, "user", None)]
    got = chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["reply_pos"])] == list(range(300))
    assert {r["reply_pos"] for r in got if r["conv_id"] == 1} == set(range(300)) and sum(r["n_linked"] for r in got) == 299


def test_token_counts_of_common_texts(spark, tmp_path):
    """Texts that most rows share are joined apart; the counts are the library's all the same."""
    from tokenizers import Tokenizer

    from augury.llm import token_counts
    from augury.llm.queries import BYTE_BPE

    texts = [None] * 300 + [""] * 300 + ["common words here"] * 900 + [f"rare text {i}" for i in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    t = Tokenizer.from_file(BYTE_BPE)
    want = {x: len(t.encode(x or "", add_special_tokens=False).ids) for x in set(texts)}
    got = token_counts.count_tokens(df, BYTE_BPE, f"{tmp_path}/cache").collect()
    assert len(got) == len(texts) and all(r["n_tokens"] == want[texts[r["doc_id"]]] for r in got)
