"""Registered queries on the smallest tables; the pipeline against its stages' brute force."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def test_names():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names}


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert 4 <= len(P.STAGES) <= 5
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    for i, (_, stage) in enumerate(P.STAGES):
        before, docs = docs, stage(spark, docs, DIR).cache()
        kept = {r[0] for r in docs.select("doc_id").collect()}
        assert kept <= {r[0] for r in before.select("doc_id").collect()} and kept
        if i < len(P.STAGES) - 1:
            assert docs.columns == before.columns
        clean = {k for k, r in labels.items() if r["quality"] == 1}
        if i == 0:
            assert len(clean & kept) >= 0.95 * len(clean)
    assert P.run(spark, DIR).count() == docs.count()


def test_pipeline_tells_rows_of_one_id_apart(spark, tmp_path):
    import corpus_pipeline as P

    say = lambda k, n=30: " ".join(f"{k}w{i}" for i in range(n))
    copied, item = say("copied"), say("item", 12)
    rows = [(None, say("a")), (None, say("b")), (None, say("c")), (7, say("d")), (7, say("e")), (7, say("d")),
            (1, copied), (9, copied), (9, say("f")), (None, copied), (None, say("g") + " x"), (None, say("g")),
            (None, None), (None, None), (None, ""), (3, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _document int")
    got = P.keep_distinct(spark, docs, DIR)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(kept) == len(set(kept)) and ((None, say("g")) in kept) + ((None, say("g") + " x") in kept) == 1
    assert {k for k in kept if not (k[1] or "").startswith("gw")} == {(None, say("a")), (None, say("b")), (None, say("c")), (7, say("d")), (7, say("e")), (1, copied), (9, say("f")), (None, None), (None, ""), (3, ""), (4, "")}

    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, say("a")), (None, f"x {item} y"), (None, None), (7, say("d")), (7, item), (8, item), (7, say("d"))], "doc_id long, text string")
    clean = P.keep_clean(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(map(repr, [(None, say("a")), (None, None), (7, say("d")), (7, say("d"))]))


@pytest.mark.parametrize("name", ["op6_quote_links", "op7_jaccard_join", "op10_decontamination"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    said = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in said.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in said.fetchall())


def test_quotes_against_sql(spark, tmp_path):
    """The given conversations hold no quotes: here half of the messages quote others, whole, by line, and nested."""
    import random

    import duckdb

    from augury.llm import queries as Q

    rng, rows = random.Random(5), []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 12)):
            own = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]
            lines = []
            for _ in range(rng.randint(0, 2) if said else 0):
                quoted = rng.choice(said)
                quoted = rng.sample(quoted, rng.randint(1, len(quoted))) if rng.random() < 0.4 else quoted
                lines += rng.choice([[], ["On Monday x wrote:"], ["x wrote:"]]) + [rng.choice(["> ", ">", ">> ", " > > "]) + q for q in quoted]
                lines += own[:1]
            said.append(own)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(lines + own)))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    df = Q.op6_quote_links(spark, str(tmp_path))
    said = con.execute(Q.SQL["op6_quote_links"])
    at = [[c[0] for c in said.description].index(c) for c in df.columns]
    got = df.collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(r[i] for i in at)) for r in said.fetchall())
    assert sum(r["n_linked"] for r in got) > 20


def test_pipeline_against_brute_force(spark):
    """Every stage by plain means: texts scored one by one, all pairs compared, windows sought one by one, the library's ids."""
    import hashlib

    import sentencepiece

    import corpus_pipeline as P
    from augury.llm import quality, toxicity
    from augury.llm.common import crc32_mod
    from augury.llm.queries import PIECE_BPE
    from tests.llm.test_llm_operators import brute_components, brute_hits

    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    score = quality.Scorer(quality.fit(docs, labels, crc32_mod("doc_id", 3) != 1))
    rows = [(i, x) for i, x in rows if score([x or ""])[0] >= 0.5]
    kept = docs.where(docs["doc_id"].isin([i for i, _ in rows]))
    score = toxicity.Scorer(toxicity.fit(kept, labels, crc32_mod("doc_id", 5) != 0))
    rows = [(i, x) for i, x in rows if score([x or ""])[0] < 0.5]
    rows = [r for r, c in zip(rows, brute_components([x for _, x in rows]), strict=True) if rows[c] == r]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rows = [(i, x) for i, x in rows if not brute_hits(x, items)[1]]
    p = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    want = [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest()) for i, ids in ((i, p.encode(x or "")) for i, x in rows)]
    got = P.run(spark, DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want and 20 < len(want) < docs.count()


def test_pipeline_resumes_after_a_crash(spark, tmp_path, monkeypatch):
    """Killed in its third stage and started again, the pipeline goes on there; changed inputs start it anew and empty the old tables."""
    import shutil

    import corpus_pipeline as P
    from augury.operators.stages import Manifest

    for n in ("documents", "labels", "benchmark"):
        shutil.copy(f"{DIR}/{n}.parquet", f"{tmp_path}/{n}.parquet")
    ran, folder = [], f"{tmp_path}/stages"

    def watched(fail):
        def stage(name, f):
            def run(spark, docs, sf_dir):
                ran.append(name)
                if name == fail:
                    raise RuntimeError("killed")
                return f(spark, docs, sf_dir)

            return name, run

        return [stage(*s) for s in STAGES]

    STAGES = P.STAGES
    monkeypatch.setattr(P, "STAGES", watched("near_copies"))
    with pytest.raises(RuntimeError):
        P.resume(spark, str(tmp_path), folder)
    monkeypatch.setattr(P, "STAGES", watched(None))
    got = sorted(map(tuple, P.resume(spark, str(tmp_path), folder).collect()))
    assert ran == ["quality", "toxicity", "near_copies", "near_copies", "decontaminate", "pieces"]
    assert got == sorted(map(tuple, P.run(spark, DIR).collect()))
    old = [r["path"] for r in Manifest(spark, folder).rows().collect()]
    spark.read.parquet(f"{DIR}/documents.parquet").limit(60).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/fewer")
    shutil.move(f"{tmp_path}/documents.parquet", f"{tmp_path}/before")
    shutil.move(f"{tmp_path}/fewer", f"{tmp_path}/documents.parquet")
    ran.clear()
    P.resume(spark, str(tmp_path), folder)
    assert ran == [n for n, _ in STAGES] and all(spark.read.parquet(p).count() == 0 for p in old)
