"""The training-data operators on small fixtures: brute force, exact round trips, edge cases.

Every operator meets: null, empty and white-space texts, a long text, ties, repeated rows and ids, an empty
table, and extra columns whose names it uses itself.
"""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from augury.llm import ann, chat, decontam, html, jaccard, pieces, quality, sharding, token_counts, toxicity
from augury.llm.common import crc32_mod, fresh_path
from augury.llm.queries import BYTE_BPE, PIECE_BPE

ODD = [None, "", " ", "  two  spaces ", "a", "one two three four", "tab\tand\nlines\n", "Ünïcödé ß ▁ mark 中文 🙂", "<|endoftext|> </s>", "x" * 3000, "word " * 4000]
SCHEMA = "doc_id long, text string, score string, _text string, ids int, n string, key string, size int, hits int"


def table(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "s", "t", 1, "n", "k", 2, 3) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def odd(spark):
    df = table(spark, ODD)
    return df.unionByName(df.where("doc_id in (0, 5)"))  # repeated rows


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def test_token_counts(spark, odd, nothing):
    from tokenizers import Tokenizer

    t, cache = Tokenizer.from_file(BYTE_BPE), fresh_path(spark, "cache")
    want = {i: len(e.ids) for i, e in enumerate(t.encode_batch([x or "" for x in ODD], add_special_tokens=False))}
    got = token_counts.count_tokens(odd, BYTE_BPE, cache).collect()
    assert len(got) == len(ODD) + 2 and all(r["n_tokens"] == want[r["doc_id"]] and r["n_bytes"] == len((ODD[r["doc_id"]] or "").encode()) for r in got)
    stored = token_counts.read_cache(spark, cache, token_counts.tokenizer_digest(BYTE_BPE))
    n = stored.count()
    assert n == len({x or "" for x in ODD})  # each distinct text once
    again = token_counts.count_tokens(odd, BYTE_BPE, cache)
    assert {(r["doc_id"], r["n_tokens"]) for r in again.collect()} == set(want.items())
    assert token_counts.read_cache(spark, cache, token_counts.tokenizer_digest(BYTE_BPE)).count() == n  # nothing was encoded anew
    assert token_counts.count_tokens(nothing, BYTE_BPE, fresh_path(spark, "cache")).count() == 0


def test_chunks_count_like_whole_texts():
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(BYTE_BPE), random.Random(4)
    texts = ["".join(rng.choice(" \n\tab'1!é中　\xa0\x1c🙂᠎") for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    assert token_counts.ChunkCounter(BYTE_BPE)(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces(spark, odd, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = pieces.encode_decode(odd, PIECE_BPE).collect()
    assert len(got) == len(ODD) + 2 and got[0]["score"] == "s"
    for r in got:
        ids = sp.encode(ODD[r["doc_id"]] or "")
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids)
    assert pieces.encode_decode(nothing, PIECE_BPE).count() == 0


def test_pieces_random():
    import numpy as np
    import sentencepiece

    sp, rng = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), random.Random(9)
    texts = ["".join(rng.choice("  ab▁.\né中🙂　") for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    ids, decoded = pieces.PieceTable(PIECE_BPE)(texts)
    assert [np.frombuffer(b, np.int32).tolist() for b in ids] == sp.encode(texts) and decoded == sp.decode(sp.encode(texts))


def words(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(240):
        text, toxic, good = words(rng, 40), i % 3 == 0, i % 4 != 0
        if not good:
            text = " ".join(f"{w}***" for w in text.split()) if i % 8 else "same " * 40
        if toxic:
            text = text.replace(" ", f" {rng.choice(['idiot', 'moron', 'stupid'])} ", 1)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, labelled, odd, nothing):
    docs, labels = labelled
    held = crc32_mod("doc_id", 3) == 1
    model = quality.fit(docs, labels, ~held)
    got = quality.score_texts(docs, model).join(labels, "doc_id").where(held).collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in got) >= 0.95 * len(got) > 0
    scores = {r["doc_id"]: r["score"] for r in quality.score_texts(odd, model).collect()}
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores.values()) and scores[0] == scores[1] == scores[2]
    assert quality.score_texts(nothing, model).count() == 0
    alone = quality.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert all(r["score"] > 0.99 for r in quality.score_texts(odd, alone).collect())
    assert quality.fit(docs, labels.where("false"), F.lit(True)).bias > 5


def test_toxicity(spark, labelled, odd, nothing):
    docs, labels = labelled
    held = crc32_mod("doc_id", 5) == 0
    model = toxicity.fit(docs, labels, ~held)
    got = toxicity.score_texts(docs, model).join(labels, "doc_id").where(held).collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in got) >= 0.95 * len(got) > 0
    hidden = ["an 1d10t here", "an i d i o t here", "such a m0r0n", "stuuuupid", "st*pid", "$tup1d", "id-iot", "m.o.r.o.n"]
    plain = ["clean words here", "onre*** thing&&&", "call 1234 or 5678", "THE!! END!!", None, ""]
    scores = [r["score"] for r in toxicity.score_texts(table(spark, hidden + plain), model).orderBy("doc_id").collect()]
    assert all(s >= 0.5 for s in scores[: len(hidden)]), list(zip(hidden, scores))
    assert all(s < 0.5 for s in scores[len(hidden):]), scores
    restored = [r["restored"] for r in toxicity.restore_texts(table(spark, hidden[:3]), model).orderBy("doc_id").collect()]
    assert "idiot" in restored[0] and "idiot" in restored[1] and "moron" in restored[2]
    assert toxicity.score_texts(odd, model).count() == len(ODD) + 2 and toxicity.score_texts(nothing, model).count() == 0
    assert all(r["score"] < 0.01 for r in toxicity.score_texts(odd, toxicity.fit(docs, labels.where("false"), F.lit(True))).collect())


def test_best_fit_decreasing_is_the_plain_one():
    rng = random.Random(2)
    for _ in range(60):
        sizes, cap = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))], rng.randint(40, 90)
        bins: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [(r, i) for i, r in enumerate(bins) if r >= s]
            if fits:
                bins[min(fits)[1]] -= s
            else:
                bins.append(cap - s)
        runs = sharding.pack(list({s: sizes.count(s) for s in sizes}.items()), cap)
        assert len({b for *_, b in runs}) == len(bins) and sum(n for _, n, _ in runs) == len(sizes)
        used = [sum(s * n for s, n, b in runs if b == i) for i in range(len(bins))]
        assert sorted(cap - u for u in used) == sorted(bins)


def test_sharding(spark, nothing):
    rng = random.Random(5)
    texts = [*ODD, *(words(rng, rng.randint(1, 60)) for _ in range(150)), *(["copied text here"] * 40)]
    got = sharding.shard_groups(table(spark, texts), shards=8).collect()
    assert len(got) == len(texts)
    of = {}
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        assert of.setdefault(t, r["shard"]) == r["shard"]
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["shard"] for r in got} <= set(range(8))
    few = sharding.shard_groups(table(spark, ["a" * 9] * 2 + ["b" * 19, "c" * 9]), capacity=30).collect()
    assert len({r["shard"] for r in few}) == 2
    assert sharding.shard_groups(nothing, shards=8).count() == 0


def test_sharding_is_even_beside_large_groups(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.randint(5, 40)) for _ in range(400)]
    rest = sum(len(t) + 1 for t in texts)
    for copied in ([1 / 2], [1 / 2, 1 / 5]):  # bytes of groups of copies, as parts of the others' bytes
        large = [f"copied text {i}" for i in range(len(copied))]
        counts = [round(rest * part / (len(t) + 1)) for part, t in zip(copied, large, strict=True)]
        rows = [*texts, *(t for t, n in zip(large, counts, strict=True) for _ in range(n))]
        of, used = {}, Counter()
        for r in sharding.shard_groups(table(spark, rows), shards=8).collect():
            assert of.setdefault(rows[r["doc_id"]], r["shard"]) == r["shard"]
            used[r["shard"]] += r["size"]
        own = {of[t] for t in large}
        assert len(own) == len(large) and all(used[of[t]] == (len(t) + 1) * n for t, n in zip(large, counts, strict=True))
        others = [used[s] for s in range(8) if s not in own]
        assert min(others) >= 0.95 * rest / len(others) and max(others) <= 1.05 * rest / len(others)
    assert sharding.even_packing([(10, 2), (3, 1), (1, 4)], 3) == [(10, 1, 0), (10, 1, 1), (3, 1, 2), (1, 4, 2)]
    assert sharding.even_packing([(7, 1)], 1) == [(7, 1, 0)] and sharding.even_packing([], 8) == []


def test_nearest_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (900, 12)).round(3)
    x[50:60] = x[5]  # equal vectors: ties by id
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5, [float(v) for v in x[5]]), (2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [None] * 12), (2004, [1.0, 2.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = ann.nearest(df, F.col("vec_id") % 5 == 0, shard_rows=300, query_rows=50).collect()
    hit = total = 0
    for q in range(0, 900, 5):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        have = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [h[0] for h in have] == list(range(1, 11)) and all(h[2] == d[h[1]] for h in have)
        assert [(h[2], h[1]) for h in have] == sorted((h[2], h[1]) for h in have)
        hit, total = hit + len(set(want) & {h[1] for h in have}), total + 10
    assert hit / total >= 0.95
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 5), key=lambda r: r["rank"])] == list(range(50, 60))
    assert not [r for r in got if r["query_id"] in (2000, 2001, 2002, 2003)]
    few = ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3 and ann.nearest(df.where("false"), F.lit(True)).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("bounds", [{}, {"frequent": 2, "short": 1}, {"frequent": 6, "short": 8}])
def test_jaccard_join(spark, bounds):
    """With low bounds nearly all shingles are frequent, and families and lists long."""
    rng = random.Random(11)
    base = [words(rng, rng.randint(5, 90)) for _ in range(12)]
    common, chosen = words(rng, 30), words(rng, 110).split()
    texts = list(ODD)
    for b in base:
        for _ in range(rng.randint(1, 9)):
            w = b.split()
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = words(rng, 1)
            texts.append(" ".join(w))
    for _ in range(90):  # a large group of near copies, linked and not
        w = list(chosen)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4, 5, 6, 8])):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    texts += [common + " " + words(rng, n) for n in range(0, 24)] + ["ONE two Three four", "one\ttwo three  four"]
    want = brute_components(texts)
    assert len(set(want[-116:-26])) > 5
    df = table(spark, texts)
    got = jaccard.link_components(df.unionByName(df.where("doc_id = 5")), **bounds).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(shingles(texts[r["doc_id"]])), want[r["doc_id"]])
    assert jaccard.link_components(table(spark, []), **bounds).count() == 0
    assert jaccard.link_components(table(spark, ["", None]), **bounds).count() == 2


def test_combinations_of_tokens():
    """Sets that share the needed tokens share a combination."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (set(rng.integers(0, 40, rng.integers(1, 25)).tolist()) for _ in range(2))
        for need in range(1, len(x & y) + 1):
            for single in (True, False) if need > 1 else (True,):
                a, b = (set(jaccard.combinations(t, t.astype(np.int64), need, single).tolist()) for t in (np.array(sorted(s), np.uint64) for s in (x, y)))
                assert a & b


def test_stars_unite_like_one_task(spark, monkeypatch):
    rng = random.Random(8)
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, rng.randint(101, 140)) for _ in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)], "a long, b long").where("a <> b")
    one = {tuple(r) for r in jaccard.components(links).collect()}
    monkeypatch.setattr(jaccard, "TASK_LINKS", 0)
    assert {tuple(r) for r in jaccard.components(links).collect()} == one


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nhow are you"), (1, 1, "assistant", "> Hello   THERE\n> how are you\nfine"), (1, 2, "user", "> fine\n>> how are you\n> not said\ngood"), (1, 3, "user", "no quote"),
            (2, 0, "user", "> Hello there\nnew"), (1, 1, "assistant", "> Hello   THERE\n> how are you\nfine"), (3, 0, None, None), (None, 0, "user", "x"), (1, None, "user", "> no quote")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(1)).withColumn("m", F.lit(2))
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_quotes(df).collect()}
    assert len(got) == 8
    assert (got[1, 1]["text"], got[1, 1]["parent_turn"], got[1, 1]["n_quoted"], got[1, 1]["n_linked"]) == ("fine", 0, 1, 1)
    assert (got[1, 2]["text"], got[1, 2]["parent_turn"], got[1, 2]["n_quoted"], got[1, 2]["n_linked"], got[1, 2]["max_level"]) == ("good", 1, 3, 2, 2)
    assert got[2, 0]["parent_turn"] is None and got[3, 0]["text"] == "" and got[1, None]["parent_turn"] is None
    assert [got[1, t]["reply_pos"] for t in (None, 0, 1, 2, 3)] == [0, 1, 2, 3, 4]
    assert chat.link_quotes(df.where("false")).count() == 0


PAGE = """<html><body><div id="header">Site</div><nav>menu</nav><div class="wrap w2"><div class="sidebar-1">x <a href=#>links</a></div><div class="post-{n}"><h2>Title &amp; more</h2>
<p>One <i>two</i>\nthree&nbsp;four and enough text to be the main part of it</p><ul><li>a<li>b</ul><form><input>no</form><script>var t="</p>";</script><p>tail<br>line</div><div class="comments"><p>me too</p></div></div><div class=footer>c</div></body>"""


def test_html(spark):
    long = "<div>" * 400 + "<p>deep</p>" + "</div>" * 400
    pages = [PAGE.replace("{n}", str(i)) for i in range(5)] + [None, "", "plain text", "<p>cut <b", "<article><p>only</article>", long, "<script>never closed"]
    rows = [(i, f"https://a.example/{i}" if i < 5 else None, p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))
    got = {r["page_id"]: r["text"] for r in html.extract_pages(df).collect()}
    want = "Title & more\nOne two three four and enough text to be the main part of it\na\nb\ntail line"
    assert all(got[i] == want for i in range(5)) and got[5] == got[6] == got[11] == "" and got[9] == "only" and got[10] == "deep" and got[7] == "plain text"
    joined = html.extract_pages(df, broadcast_bytes=-1)  # winners too large to broadcast
    assert {r["page_id"]: r["text"] for r in joined.collect()} == got
    assert html.extract_pages(df.where("false")).count() == 0


@pytest.mark.parametrize("attrs, out", [
    ('style="overflow:hidden"', False), ("style='overflow-x: hidden'", False), ('aria-hidden="false"', False), ('title="a hidden valley"', False), ("data-hidden", False), ("title=hidden", False),
    ('data-id="sidebar"', False), ('data-role="banner"', False), ('data-class="footer"', False), ('title="class=sidebar"', False), ('class="post" data-class="sidebar"', False), ("data-x=1/id=nav", False),
    ("hidden", True), ('HIDDEN=""', True), ('title="x"hidden', True), ('role = "Banner"', True), ("id=sidebar", True), ("class='wrap sidebar-1'", True), ('data-id="a" id="comments"', True),
])
def test_html_attributes(attrs, out):
    page = f"<html><body><div class=wrap><section {attrs}><p>inside of it</p></section><p>the text beside it</p></div></body></html>"
    assert html.extract(page, "/html/body/div.wrap") == ("" if out else "inside of it\n") + "the text beside it"


def test_html_keeps_pages_that_hide_overflow(spark):
    pages = ['<html><body style="overflow-x:hidden"><p>whole page</p></body></html>', '<body><div style="overflow:hidden"><article><p>whole article</p></article></div></body>', "<body><article hidden><p>not shown</p></article></body>"]
    df = spark.createDataFrame([(i, f"https://h{i}.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract_pages(df).collect()} == {0: "whole page", 1: "whole article", 2: ""}


def brute_hits(doc, items, window=10):
    import re

    cut = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    w, hit, found = cut(doc), set(), set()
    for i, text in items:
        x = cut(text)
        n = min(window, len(x))
        wins = {tuple(x[s:s + n]) for s in range(len(x) - n + 1)} if x else set()
        for s in range(len(w) - n + 1):
            if tuple(w[s:s + n]) in wins:
                hit.update(range(s, s + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination(spark, limit):
    rng = random.Random(3)
    vocabulary = words(rng, 30).split() + ["École", "ÉCOLE", "Two-Part"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(50, None), (51, ""), (52, "...")]
    items += [(60, items[5][1]), (5, items[5][1])]
    docs = [*ODD, *(say(rng.randint(0, 60)) for _ in range(25))]
    docs += [f"{say(4)}! {t.upper() if t.isascii() else t}, {say(3)}" for _, t in items if t]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    df = table(spark, docs)
    got = decontam.find_windows(df.unionByName(df.where("doc_id = 5")), bench, broadcast_bytes=limit).collect()
    assert len(got) == len(docs) + 1
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(docs[r["doc_id"]], items), docs[r["doc_id"]]
    assert decontam.find_windows(df.where("false"), bench, broadcast_bytes=limit).count() == 0
    assert decontam.find_windows(df, bench.where("false"), broadcast_bytes=limit).where("n_hit > 0").count() == 0


def test_digest_query_columns(spark):
    from augury.llm.queries import piece_digests

    r = piece_digests(table(spark, [None]).select("doc_id", "text")).first()
    assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_viterbi_against_all_readings():
    """The decoder's reading of short tokens has the best score of all paths through the lattice."""
    import numpy as np

    rng = np.random.default_rng(2)
    counts = rng.integers(0, 40, toxicity.SYMBOLS**4) * (rng.random(toxicity.SYMBOLS**4) < 0.2)
    logs, ids, n = toxicity.log_probabilities(counts.astype(float)), toxicity._symbols(), toxicity.SYMBOLS
    decode = toxicity.Decoder(logs)

    def cost(reading):
        at, total = 0, 0.0
        for text, c in reading:
            total += c
            for char in text:
                s = int(ids[ord(char)])
                if s or at % n:
                    total += logs[at * n + s]
                    at = (at * n + s) % n**3
        return total + (logs[at * n] if at % n else 0.0)

    for token, spaced in (("h3ll0", False), ("b@@d", False), ("cooool", False), ("x_y.z", False), ("a s s", True), ("i d 1 0 t", True), ("f*n", False), ("9", False)):
        runs = [(m[1], len(m[0])) for m in toxicity._RUN.finditer(token)]
        readings = list(itertools.product(*(decode.options(c, k, spaced) for c, k in runs)))
        best = max(map(cost, readings))
        said = decode(token, spaced)
        assert max(cost(r) for r in readings if "".join(t for t, _ in r) == said) == pytest.approx(best, abs=1e-4)


def test_quality_scores_feature_by_feature():
    import math

    import numpy as np

    rng = random.Random(4)
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.3)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(20)] + ["a a a b", "", " ", "ünï ünï 中文", "x" * 5000]
    mask = (1 << 32) - 1
    for text, got in zip(texts, quality.Scorer(model)(texts), strict=True):
        found = []
        for i, w in enumerate(text.split()):
            found.append(zlib.crc32(w.encode()) & (quality.BUCKETS - 1))
            b = b"<" + w.encode() + b">"
            for j in range(len(b) - 2):
                h = (b[j] * 0x9E3779B1 & mask) ^ (b[j + 1] * 0x85EBCA77 & mask) ^ (b[j + 2] * 0xC2B2AE3D & mask)
                found.append(((h ^ (h >> 15)) * 0x2C1B3C6D & mask) >> 15)
            found += [quality.REPEAT] * 4 if i and w == text.split()[i - 1] else []
        z = model.bias + (sum(float(model.weights[f]) for f in found) / len(found) if found else 0.0)
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


@pytest.mark.parametrize("body, text", [
    ('<div class="content has-sidebar"><p>kept</p></div>', "kept"), ('<p>alpha <span class="search-hit">gamma</span> beta</p>', "alpha gamma beta"), ('<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>', "so x=1 holds"),
    ('<iframe src="a" /><p>after it</p>', "after it"), ("<p>one<textarea>two</p><p>three</p>", "onetwo\nthree"), ('<p>said <span class="ad">buy</span>so</p>', "said so"), ('<p>a</p><div style="display: none">b</div><p aria-hidden="true">c</p>', "a"),
    ('<div class="page-header-fixed"><h1>Title</h1><p>the whole article stands in here</p></div>', "Title\nthe whole article stands in here"), ('<form action="/x"><h1>Title</h1><p>the whole page is one form</p></form>', "Title\nthe whole page is one form"),
    ('<div class="site-header"><h1>Paper</h1></div><p>an article longer than what stands above it</p>', "an article longer than what stands above it"), ('<p>short</p><div class="comments"><p>' + "much longer talk " * 20 + "</p></div>", "short"),
])
def test_html_markup(body, text):
    assert html.extract(f"<html><body>{body}</body></html>", "/html/body") == text


@pytest.mark.parametrize("name, out", [
    ("post-header-layout", False), ("entry-content comment-free", False), ("widget-area-main", False), ("has-sidebar", False), ("headerless", False),
    ("site-header", True), ("comment-list", True), ("sidebar-2", True), ("x related-posts", True), ("footer", True), ("share-buttons", True), ("cookie_notice", True), ("main-nav", True),
])
def test_html_class_names(name, out):
    page = f"<html><body><div class=wrap><div class='{name}'><p>inside of it</p></div><p>the text beside it</p></div></body></html>"
    assert html.extract(page, "/html/body/div.wrap") == ("" if out else "inside of it\n") + "the text beside it"


def test_html_slashes_in_classes_are_no_steps():
    page = "<html><body><div class='w-1/2'><p>kept</p></div></body></html>"
    path, _ = html.best_path(html.walk(page)[0])
    assert path == "/html/body/div.w-#|#" and html.extract(page, path) == "kept"


N = 20000


@pytest.mark.parametrize("page, text", [
    ("<div>" * N + "<p>deep</p>" + "</div>" * N, "deep"), ("<div>" * N + "deep", "deep"), ("<p>" + "<span>" * N + "x" + "<div>y</div>" * 50, "\n".join("y" * 50)), ("<table><tr><td>" * (N // 3) + "cell", "cell"),
    ("<div class=sidebar>" * N + "<h1>T</h1><p>all of it</p>", "T\nall of it"), ("<li>" * N + "x", "x"), ("<iframe>" * N + "x", "x"), ("<![CDATA[" * N + "x>y", None), ('<a "' * N + "x", None), ('<a ">"' * N + "x", None),
    ("<a " * N, None), ("<" * N, None), ("<!--" * N, ""), ("</p>" * N + "x", "x"), ("<p>one<button>" * 5000, None), ("<b><i>" * N + "x" + "</b>" * N, "x"), ("".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}><p>t</p></div>" for i in range(N // 4)), None),
])
def test_html_is_linear(page, text):
    import time

    began = time.process_time()
    got = html.extract(page, None)
    assert time.process_time() - began < 3  # under 1 s on a free core
    assert text is None or got == text


def test_html_against_a_tree():
    """Random well-formed pages: a tree built by the standard parser, its blocks gathered recursively."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.at = ("#", {}, [], None)

        def handle_starttag(self, tag, attrs):
            node = (tag, dict(attrs), [], self.at)
            self.at[2].append(node)
            self.at = node

        def handle_endtag(self, tag):
            self.at = self.at[3]

        def handle_data(self, data):
            self.at[2].append(data)

    def gather(node, out):
        for kid in node[2]:
            if isinstance(kid, str):
                out.append(kid)
            elif kid[0] not in ("script", "nav", "aside") and "hidden" not in kid[1] and kid[1].get("class") != "comments" and (kid[1].get("class") != "ad-slot" or kid[0] not in html.BLOCK):
                part = kid[0] in html.BLOCK
                out.append("\0" if part else "")
                gather(kid, out)
                out.append("\0" if part else "")
            elif kid[0] in html.BLOCK:
                out.append("\0")

    rng = random.Random(6)

    def make(depth):
        made = ""
        for _ in range(rng.randint(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                made += rng.choice(["one two", " three ", "a &amp; b", "\\n", "x&lt;y "])
                continue
            tag, attrs = rng.choice(["div", "section", "ul", "em", "b", "span", "nav", "aside", "script"]), rng.choice(["", "", ' class="post"', ' class="comments"', ' class="ad-slot"', " hidden", ' data-x="nav"'])
            made += f"<{tag}{attrs}>{'var x=1' if tag == 'script' else make(depth - 1)}</{tag}>"
        return made

    for _ in range(300):
        page = f"<html><body>{make(4)}</body></html>"
        tree, out = Tree(), []
        tree.feed(page)
        gather(tree.root, out)
        blocks = [" ".join(b.split()) for b in "".join(out).split("\0")]
        assert html.walk(page, "/html/body")[1] == [b for b in blocks if b], page


def test_decontamination_with_ids_of_any_kind(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([("d1", f"x {item} y", 1), (None, item, 2), ("d3", "nothing", 3), ("d3", "nothing", 3)], "_text string, body string, hits int")
    bench = spark.createDataFrame([("b", item), ("a", item), (None, "other words")], "item_id string, text string")
    for limit in (64 << 20, 0):
        got = sorted(((r["_text"], r["n_hit"], r["items"]) for r in decontam.find_windows(docs, bench, id_col="_text", text_col="body", broadcast_bytes=limit).collect()), key=repr)
        assert got == sorted([("d1", 14, ["a", "b"]), (None, 14, ["a", "b"]), ("d3", 0, []), ("d3", 0, [])], key=repr)


def test_reply_threads(spark):
    rows = [(1, 0, "u", "first point made here"), (1, 1, "u", "an unrelated turn"), (1, 2, "a", "> an unrelated turn\nanswer to it"), (1, 3, "a", "On Monday Ann wrote:\n> first point made here\nanswer to the first"),
            (1, 4, "u", "> answer to the first\nand on"), (1, 5, "u", "He wrote:\nnothing is quoted")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in chat.link_quotes(df).collect()}
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1]["reply_pos"])] == [0, 3, 4, 1, 2, 5]
    assert got[3]["text"] == "answer to the first" and got[3]["parent_turn"] == 0 and got[5]["text"] == "He wrote:\nnothing is quoted"
    assert all(r["parent_turn"] is None or got[r["parent_turn"]]["reply_pos"] < r["reply_pos"] for r in got.values())
