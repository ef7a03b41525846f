"""Search: lexical, vector and fused retrieval, provenance, analytics, distinctive terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions.text import words
from augury.functions.tokens import pairs_told, worded
from augury.functions.vectors import cosine
from augury.operators import search as S
from augury.operators.stages import Manifest, files_digest
from augury.operators.textindex import TextIndex

from .catalog import query, t

_W = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
_LEX = f"SELECT doc_id, ln(1 + len(list_filter(w, lambda x: x = 'the'))) + ln(1 + len(list_filter(w, lambda x: x = 'with'))) AS score FROM (SELECT doc_id, {_W} AS w FROM documents) WHERE list_contains(w, 'the') AND list_contains(w, 'with')"
_VEC = "SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS score FROM embeddings WHERE vec_id <> 7"


def text_index(spark, d):
    """The index of the documents' texts: built once for the files as they are, found again by the manifest."""
    docs, m = t(spark, d, "documents"), Manifest(spark)
    key = m.key("text-index", files_digest(docs), {"id": "doc_id", "text": "text"})
    if (path := m.find("text-index", key)) is None:
        path = m.place("text-index")
        TextIndex(spark, path).append(docs.select("doc_id", "text"))
        m.finish("text-index", key, path)
    return TextIndex(spark, path)


def _lex(spark, d):
    """Documents with both words as they are, scored from the index's postings."""
    return text_index(spark, d).scores(["the", "with"], by="term").withColumnRenamed("id", "doc_id")


def _vec(spark, d):
    e = t(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 7").select(F.col("embedding").alias("q")))  # one row
    return e.where("vec_id <> 7").crossJoin(q).select("vec_id", cosine("embedding", "q").alias("score"))


@query(f"""SELECT doc_id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM ({_LEX}) QUALIFY rank <= 50""")
def lexical_topk(spark, d):
    return S.top_k(_lex(spark, d), 50, "doc_id").withColumn("score", F.round("score", 4))


@query(f"""SELECT vec_id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM ({_VEC}) QUALIFY rank <= 100""")
def vector_topk(spark, d):
    return S.top_k(_vec(spark, d), 100, "vec_id").withColumn("score", F.round("score", 4))


_LISTS = f"""l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_LEX}) QUALIFY rank <= 100), v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({_VEC}) QUALIFY rank <= 100)"""


def _fused(spark, d):
    lists = {"text": S.top_k(_lex(spark, d), 100, "doc_id").select(F.col("doc_id").alias("id"), "rank"), "vector": S.top_k(_vec(spark, d), 100, "vec_id").select(F.col("vec_id").alias("id"), "rank")}
    return S.fuse(lists, "id")


@query(f"""WITH {_LISTS} SELECT id, round(sum(1.0 / (60 + rank)), 6)::DOUBLE AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY id ORDER BY score DESC, id DESC LIMIT 40""")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("id", "score").orderBy(F.desc("score"), F.desc("id")).limit(40)


@query(f"""WITH {_LISTS} SELECT coalesce(l.id, v.id) AS id, CASE WHEN l.id IS NOT NULL AND v.id IS NOT NULL THEN 'text+vector' WHEN l.id IS NOT NULL THEN 'text' ELSE 'vector' END AS found_by FROM l FULL JOIN v ON l.id = v.id""")
def search_provenance(spark, d):
    return _fused(spark, d).select("id", "found_by")


@query(f"""WITH h AS ({_LEX}) SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM h JOIN documents USING (doc_id) GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM h JOIN documents USING (doc_id) GROUP BY ALL
UNION ALL SELECT 'quality', coalesce(quality::VARCHAR, 'unknown'), count(*) FROM h LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def search_analytics(spark, d):
    hits = _lex(spark, d).select("doc_id")
    rows = hits.join(t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    facets = F.array(*(F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in ("lang", "source", "quality")))
    return rows.select(F.inline(facets)).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT doc_id, lang = 'en' AND source = 'src1' AS h, list_distinct({_W}) AS w FROM documents), n AS (SELECT count(*) AS n_all, count(*) FILTER (WHERE h) AS n_hit FROM d),
x AS (SELECT term, count(*) FILTER (WHERE h) AS hits, count(*) AS df FROM (SELECT h, unnest(w) AS term FROM d) GROUP BY term HAVING count(*) FILTER (WHERE h) >= 3)
SELECT term, hits, df, round((hits / n_hit) / (df / n_all), 4) AS lift FROM x, n ORDER BY lift DESC, term LIMIT 50""")
def distinctive_terms(spark, d):
    got = S.distinctive_terms(t(spark, d, "documents"), (F.col("lang") == "en") & (F.col("source") == "src1"))
    return got.orderBy(F.desc("lift"), "term").limit(50)


@query(f"""SELECT source, term, n AS tf, round(n * ln((SELECT count(DISTINCT source) FROM documents)::DOUBLE / df), 4) AS tfidf FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(list_distinct({_W})) AS term FROM documents) GROUP BY ALL))
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n * ln((SELECT count(DISTINCT source) FROM documents)::DOUBLE / df) DESC, term) <= 3""")
def tfidf_cotags(spark, d):
    from pyspark.sql import Window as W

    from augury.operators.relational import first_per_key

    docs = t(spark, d, "documents")
    n = docs.select("source", F.explode(F.array_distinct(words("text"))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("tf"))
    total = docs.agg(F.count_distinct("source").alias("total"))  # one row
    x = n.withColumn("df", F.count("*").over(W.partitionBy("term"))).crossJoin(total).withColumn("x", F.col("tf") * F.log(F.col("total") / F.col("df")))
    return first_per_key(x, ["source"], [F.desc("x"), F.col("term")], 3).select("source", "term", "tf", F.round("x", 4).alias("tfidf"))


@query(f"""WITH h AS (SELECT doc_id, lang, {_W} AS w FROM documents), g AS (SELECT lang, unnest(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS gram FROM h WHERE len(w) >= 2) SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 20""")
def frequent_bigrams(spark, d):
    """Runs are counted in batches of texts before they are sent."""
    texts = t(spark, d, "documents").where("text IS NOT NULL").select("lang", F.lower("text").alias("text"))
    told = texts.mapInArrow(lambda batches: pairs_told(worded(batches, 1 << 24)), "lang string, gram string, n bigint")
    return told.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 20")


@query("""SELECT lang, count(*) AS n FROM documents WHERE contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' of the ') GROUP BY lang""")
def phrase_counts(spark, d):
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), F.lit(" "))
    return t(spark, d, "documents").where(padded.contains(" of the ")).groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, (contains(lower(left(text, 60)), 'the'))::INT * 2 + 1 AS boost FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') AND lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src5')""")
def chips_and_substrings(spark, d):
    low = F.lower("text")
    hits = t(spark, d, "documents").where(F.forall(F.array(F.lit("the"), F.lit("ing")), lambda w: F.instr(low, w) > 0) & F.col("lang").isin("en", "de") & F.col("source").isin("src1", "src2", "src5"))
    return hits.select("doc_id", (F.lower(F.substring("text", 1, 60)).contains("the").cast("int") * 2 + 1).alias("boost"))


@query("""SELECT lang, term, df FROM (SELECT lang, term, count(*) AS df FROM (SELECT lang, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 4))) AS term FROM documents) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY df DESC, term) <= 3""")
def title_terms(spark, d):
    from augury.operators.relational import first_per_key

    terms = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) >= 4))
    df = t(spark, d, "documents").select("lang", F.explode(terms).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("df"))
    return first_per_key(df, ["lang"], [F.desc("df"), F.col("term")], 3)


_STEM = "CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND (w LIKE '%sses' OR w LIKE '%shes' OR w LIKE '%ches' OR w LIKE '%xes') THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"
_STEMMED = f"(SELECT doc_id, lang, source, [{_STEM} for w in {_W}] AS w FROM documents)"
_HELD = "(SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS x FROM {})"


@query(f"""SELECT term, len(list_distinct(ids))::BIGINT AS n_docs, len(ids)::BIGINT AS n_places FROM (SELECT term, list(doc_id) AS ids FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) GROUP BY term)""")
def index_terms(spark, d):
    """What the index holds of every word."""
    return text_index(spark, d).terms()


@query(f"""SELECT doc_id FROM {_HELD.format(_STEMMED)} WHERE contains(x, ' and ') AND contains(x, ' of the ') AND NOT contains(x, ' with ') ORDER BY doc_id DESC LIMIT 8001""")
def fulltext_all_ids(spark, d):
    """Every id that holds a stem and a phrase and not another stem, from postings alone, newest first; one more than the 8,000 that
    analytics takes tells that there are more."""
    found = text_index(spark, d).matching(["and"], phrases=[["of", "the"]], none_of=["with"])
    return found.select(F.col("id").alias("doc_id")).orderBy(F.desc("doc_id")).limit(8001)


@query(f"""SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM (SELECT doc_id, ln(1 + len(list_filter(w, lambda y: y = 'and'))) + ln(1 + len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))) AS score FROM {_STEMMED}
WHERE list_contains(w, 'and') AND len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0) QUALIFY rank <= 60""")
def fulltext_ranked(spark, d):
    """The best sixty by the damped frequencies of a stem and a phrase."""
    scored = text_index(spark, d).scores(["and"], phrases=[["of", "the"]]).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    return S.top_k(scored, 60, "doc_id")


_PAGE = "SELECT '{route}' AS route, total, total > 500 AS clamped, rank, doc_id FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY {order}) AS rank FROM ({hits})) WHERE rank <= 25"


@query(f"""WITH s AS (SELECT *, len(list_filter(w, lambda y: y = 'the')) AS n FROM {_STEMMED}),
hits AS (SELECT doc_id, round(ln(1 + n) + ln(1 + len(list_filter(w, lambda y: y = 'and'))), 6) AS score FROM s WHERE n > 0 AND list_contains(w, 'and')),
text AS ({_PAGE.format(route='text', order="CASE WHEN (SELECT count(*) FROM hits) <= 500 THEN -score END NULLS LAST, doc_id DESC", hits="SELECT * FROM hits")})
SELECT route, least(total, 501)::BIGINT AS total, clamped, rank::INT AS rank, doc_id FROM (
{_PAGE.format(route='number', order="doc_id DESC", hits="SELECT doc_id FROM documents WHERE doc_id::VARCHAR = '7' OR doc_id::VARCHAR LIKE '12%'")}
UNION ALL {_PAGE.format(route='company', order="doc_id DESC", hits="SELECT doc_id FROM s WHERE source ILIKE '%RC1%' AND n > 0")}
UNION ALL {_PAGE.format(route='class', order="n_chars DESC, doc_id DESC", hits="SELECT doc_id, n_chars FROM documents WHERE lang LIKE 'e%' AND n_chars BETWEEN 500 AND 5000")}
UNION ALL SELECT * FROM text)""")
def four_route_search(spark, d):
    """One page by each route: by number or its prefix, by part of a holder's name with a word, by class within bounds, by
    text. Totals are counted to 500 and one; a text search beyond that goes by date, below it by rank."""
    docs, index, clamp = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), text_index(spark, d), 500
    number = F.col("doc_id").cast("string")
    held = index.matching(["the"]).withColumnRenamed("id", "doc_id")
    ranked = index.scores(["the", "and"]).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    few = ranked.limit(clamp + 1).count() <= clamp
    routes = {
        "number": (docs.where((number == "7") | number.startswith("12")), [F.desc("doc_id")]),
        "company": (docs.where(F.col("source").ilike("%RC1%")).join(held, "doc_id", "left_semi"), [F.desc("doc_id")]),
        "class": (docs.where(F.col("lang").startswith("e") & F.col("n_chars").between(500, 5000)), [F.desc("n_chars"), F.desc("doc_id")]),
        "text": (ranked, ([F.desc("score")] if few else []) + [F.desc("doc_id")]),
    }
    pages = [S.clamped_page(hits, order, "doc_id", 25, clamp).select(F.lit(route).alias("route"), "total", "clamped", "rank", "doc_id") for route, (hits, order) in routes.items()]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out
