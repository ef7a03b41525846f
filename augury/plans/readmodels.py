"""Read models: what one page of the product asks for, each as one query."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.vectors import cosine
from augury.operators import blocks as B
from augury.operators.relational import first_per_key, tolerance_join

from .catalog import query, t
from .joins import _CENTRES, _COS, centres
from .search import text_index


def best(df, order, n):
    """df's first n rows of an order, numbered from 1; limit comes first, so the numbering sees n rows."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("pos", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


@query("""SELECT 'newest' AS mode, doc, pos FROM (SELECT o_orderkey AS doc, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS pos FROM orders) WHERE pos <= 10
UNION ALL SELECT 'oldest', doc, pos FROM (SELECT o_orderkey AS doc, row_number() OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey DESC) AS pos FROM orders) WHERE pos <= 10
UNION ALL SELECT 'score', doc, pos FROM (SELECT o_orderkey AS doc, row_number() OVER (ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END DESC NULLS LAST, o_orderkey DESC) AS pos FROM orders) WHERE pos <= 10
UNION ALL SELECT 'priority', doc, pos FROM (SELECT o_orderkey AS doc, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey DESC) AS pos FROM orders) WHERE pos <= 10""")
def sort_modes(spark, d):
    """Every order ends in the id, so that pages never overlap."""
    o = t(spark, d, "orders").withColumn("score", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    modes = {"newest": [F.desc_nulls_last("o_orderdate")], "oldest": [F.asc_nulls_last("o_orderdate")], "score": [F.desc_nulls_last("score")], "priority": [F.col("o_orderpriority"), F.desc("o_totalprice")]}
    out = None
    for name, order in modes.items():
        some = best(o, [*order, F.desc("o_orderkey")], 10).select(F.lit(name).alias("mode"), F.col("o_orderkey").alias("doc"), F.col("pos").cast("long"))
        out = some if out is None else out.unionByName(some)
    return out


@query("""SELECT p_partkey, coalesce(views, 0) AS views FROM part LEFT JOIN (SELECT l_partkey, count(*) AS views FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey ORDER BY coalesce(views, 0) DESC, p_retailprice DESC, p_partkey LIMIT 10""")
def engagement_top(spark, d):
    views = t(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("views"))
    x = t(spark, d, "part").select("p_partkey", "p_retailprice").join(views, "p_partkey", "left").withColumn("views", F.coalesce("views", F.lit(0)))
    return x.orderBy(F.desc("views"), F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "views")


@query("""SELECT 'contains' AS kind, name, n FROM (SELECT p_name AS name, count(*) AS n FROM part WHERE p_name ILIKE '%in%' GROUP BY 1 ORDER BY n DESC, name LIMIT 8)
UNION ALL SELECT 'prefix', name, n FROM (SELECT p_name AS name, count(*) AS n FROM part WHERE lower(p_name) LIKE 'co%' GROUP BY 1 ORDER BY n DESC, length(name), name LIMIT 1)""")
def typeahead(spark, d):
    """Names that hold what is typed, the most frequent first; and the first that begins with it."""
    names = t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    a = names.where(F.lower("name").contains("in")).orderBy(F.desc("n"), "name").limit(8)
    b = names.where(F.lower("name").startswith("co")).orderBy(F.desc("n"), F.length("name"), "name").limit(1)
    return a.select(F.lit("contains").alias("kind"), "name", "n").unionByName(b.select(F.lit("prefix").alias("kind"), "name", "n"))


@query("""SELECT l_partkey, count(*) AS cited, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#1', 'Brand#13') GROUP BY ALL ORDER BY cited DESC, l_partkey LIMIT 8""")
def top_cited_of_classes(spark, d):
    p = t(spark, d, "part").where(F.col("p_brand").isin("Brand#1", "Brand#13")).select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return t(spark, d, "lineitem").select("l_partkey").join(p, "l_partkey").groupBy("l_partkey", "p_name").agg(F.count("*").alias("cited")).orderBy(F.desc("cited"), "l_partkey").limit(8)


@query("""WITH c AS (SELECT p_brand AS nest, p_name AS tag, count(*) AS n FROM part GROUP BY ALL), g AS (SELECT nest, string_agg(tag, '|' ORDER BY n DESC, tag) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY nest ORDER BY n DESC, tag) AS i FROM c) WHERE i <= 3 GROUP BY nest),
r AS (SELECT p_brand AS nest, p_type, max(p_partkey) AS newest FROM part GROUP BY ALL), s AS (SELECT nest, string_agg(newest::VARCHAR, '|' ORDER BY newest DESC) AS reps FROM (SELECT *, row_number() OVER (PARTITION BY nest ORDER BY newest DESC) AS i FROM r) WHERE i <= 3 GROUP BY nest) SELECT * FROM g JOIN s USING (nest)""")
def nest_descriptions(spark, d):
    """A nest's most common tags, and its newest members, one of each source."""
    p = t(spark, d, "part").select(F.col("p_brand").alias("nest"), "p_name", "p_type", "p_partkey")
    listed = lambda df, x: df.groupBy("nest").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(x).cast("string").alias("x")))), lambda s: s["x"]), "|"))
    tags = p.groupBy("nest", "p_name").agg(F.count("*").alias("n")).withColumn("i", F.row_number().over(W.partitionBy("nest").orderBy(F.desc("n"), "p_name"))).where("i <= 3")
    reps = p.groupBy("nest", "p_type").agg(F.max("p_partkey").alias("newest")).withColumn("i", F.row_number().over(W.partitionBy("nest").orderBy(F.desc("newest")))).where("i <= 3")
    return listed(tags, "p_name").toDF("nest", "tags").join(listed(reps, "newest").toDF("nest", "reps"), "nest")


@query(f"""SELECT id, string_agg(via, ',' ORDER BY via) AS via FROM (SELECT doc_id AS id, 'class' AS via FROM documents WHERE lang LIKE 'e%' AND n_chars > 4000 UNION SELECT doc_id, 'topic' FROM documents WHERE source IN ('src3', 'src11')
UNION SELECT doc_id, 'phrase' FROM documents WHERE contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' of the ') UNION SELECT vec_id, 'vector' FROM embeddings e, (SELECT c FROM ({_CENTRES}) WHERE label = 3) c WHERE {_COS} >= 0.3) GROUP BY id""")
def seed_union(spark, d):
    """Seeds found in four ways, by class, topic, phrase (from the index) and vector, each id once with the ways that found it."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    c = F.broadcast(centres(spark, d).where("label = 3").select("c"))  # one row
    near = t(spark, d, "embeddings").crossJoin(c).where(cosine("embedding", "c") >= 0.3).select(F.col("vec_id").alias("id"))
    ways = {"class": docs.where(F.col("lang").startswith("e") & (F.col("n_chars") > 4000)).select("id"), "topic": docs.where(F.col("source").isin("src3", "src11")).select("id"), "phrase": text_index(spark, d).matching([], phrases=[["of", "the"]], by="term"), "vector": near}
    found = None
    for via, ids in ways.items():
        one = ids.select("id", F.lit(via).alias("via"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"))


@query("""SELECT a.p_brand AS into_, len(list_distinct(list_concat(a.m, b.m))) AS members FROM (SELECT p_brand, list(DISTINCT p_name) AS m FROM part GROUP BY 1) a JOIN (SELECT p_type, list(DISTINCT p_name) AS m FROM part GROUP BY 1) b ON b.p_type = 'ECONOMY'""")
def merged_member_sets(spark, d):
    sets = lambda k: t(spark, d, "part").groupBy(k).agg(F.collect_set("p_name").alias("m"))
    other = sets("p_type").where("p_type = 'ECONOMY'").select(F.col("m").alias("more"))  # one row
    return sets("p_brand").crossJoin(F.broadcast(other)).select(F.col("p_brand").alias("into_"), F.size(F.array_union("m", "more")).cast("long").alias("members"))


@query("""SELECT a.o_orderkey AS id, b.o_orderkey AS sibling FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(datediff('day', a.o_orderdate, b.o_orderdate)) <= 60 QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) <= 3""")
def story_siblings(spark, d):
    """Other members of the same story within 60 days, newest first, three at most: days meet in blocks, not in pairs."""
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"))
    a, b = (o.select("o_custkey", F.col("o_orderkey").alias(k), F.col("o_orderdate").alias(f"t{k}"), F.col("day").alias(f"d{k}")) for k in "ab")
    near = tolerance_join(a, b, "o_custkey", "da", "db", 60).where("a <> b").select("a", "b", "tb").distinct()
    return first_per_key(near, ["a"], [F.desc("tb"), F.desc("b")], 3).select(F.col("a").alias("id"), F.col("b").alias("sibling"))


@query("""WITH h AS (SELECT doc_id, lang, source, n_chars, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS hits FROM documents WHERE contains(lower(text), 'the')), f AS (SELECT * FROM h WHERE lang IN ('en', 'de') AND n_chars >= 300)
SELECT 'page' AS part, doc_id::VARCHAR AS key, hits::BIGINT AS n FROM (SELECT * FROM f ORDER BY hits DESC, doc_id DESC LIMIT 20) UNION ALL SELECT 'total', 'all', count(*) FROM f UNION ALL SELECT 'lang', lang, count(*) FROM h WHERE n_chars >= 300 GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM f GROUP BY source""")
def research_page(spark, d):
    """A text with facets: the page by hits, the total, and each facet's counts under the other filters."""
    low = F.lower("text")
    h = t(spark, d, "documents").where(low.contains("the")).select("doc_id", "lang", "source", "n_chars", F.floor((F.length(low) - F.length(F.replace(low, F.lit("the"), F.lit("")))) / 3).alias("hits"))
    long = h.where("n_chars >= 300")
    f = long.where(F.col("lang").isin("en", "de"))
    part = lambda df, name, key, n: df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), n.alias("n"))
    page = part(f.orderBy(F.desc("hits"), F.desc("doc_id")).limit(20), "page", F.col("doc_id"), F.col("hits"))
    total = part(f.agg(F.count("*").alias("n")), "total", F.lit("all"), F.col("n"))
    counts = lambda df, c: part(df.groupBy(c).agg(F.count("*").alias("n")), c, F.col(c), F.col("n"))
    return page.unionByName(total).unionByName(counts(long, "lang")).unionByName(counts(f, "source"))


@query("""WITH r AS (SELECT o_orderpriority AS scope, max(o_orderdate) AS latest FROM orders GROUP BY 1), c AS (SELECT o_orderkey, o_orderpriority AS scope FROM orders JOIN r ON o_orderpriority = scope AND o_orderdate = latest) SELECT scope, o_orderkey AS run, l_linenumber::INT AS pos, l_partkey AS member, p_name AS name FROM c JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey""")
def latest_run_hydrated(spark, d):
    """The latest run of each scope, its members taken out of an array and hydrated."""
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("scope"), "o_orderdate")
    last = o.groupBy("scope").agg(F.max("o_orderdate").alias("o_orderdate"))
    runs = o.join(F.broadcast(last), ["scope", "o_orderdate"])  # five scopes
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("pos"), "l_partkey")
    members = runs.join(li, "o_orderkey").groupBy("scope", F.col("o_orderkey").alias("run")).agg(F.collect_list(F.struct("pos", "l_partkey")).alias("xs")).select("scope", "run", F.inline("xs"))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    return members.join(p, "l_partkey", "left").select("scope", "run", "pos", F.col("l_partkey").alias("member"), "name")


@query("""SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1-%') AS funded, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS patents, count(*) OVER () AS total FROM customer WHERE c_name ILIKE '%00007%' AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_acctbal DESC, c_custkey LIMIT 25""")
def company_search(spark, d):
    """By name and verticals, with flags of what is known and the total beside the page."""
    c = t(spark, d, "customer").where(F.lower("c_name").contains("00007") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    total = F.broadcast(c.agg(F.count("*").alias("total")))  # one row
    page = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)
    o = t(spark, d, "orders").join(F.broadcast(page.select(F.col("c_custkey").alias("o_custkey"))), "o_custkey", "left_semi")  # 25 rows
    flags = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderpriority").startswith("1-")).alias("funded"), F.bool_or(F.col("o_totalprice") > 200000).alias("patents"))
    x = page.join(flags, "c_custkey", "left").crossJoin(total)
    return x.select("c_custkey", "c_name", F.coalesce("funded", F.lit(False)).alias("funded"), F.coalesce("patents", F.lit(False)).alias("patents"), "total")


@query("""SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS events, (SELECT round(sum(v), 2) FROM (SELECT DISTINCT o_orderdate, o_totalprice AS v FROM orders WHERE o_custkey = c_custkey)) AS funding, (SELECT count(*) FROM (SELECT DISTINCT ON (l_partkey) l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey)) AS families,
(SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders WHERE o_custkey = c_custkey) AS latest FROM customer WHERE c_custkey IN (3, 7, 11)""")
def company_page(spark, d):
    """Some companies whole: events, rounds counted once, distinct families, the last date."""
    c = t(spark, d, "customer").where(F.col("c_custkey").isin(3, 7, 11)).select("c_custkey", "c_name")
    o = t(spark, d, "orders").where(F.col("o_custkey").isin(3, 7, 11)).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_totalprice")
    e = o.groupBy("c_custkey").agg(F.count("*").alias("events"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"))
    funding = o.select("c_custkey", "o_orderdate", "o_totalprice").distinct().groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("funding"))
    fam = o.join(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey").groupBy("c_custkey").agg(F.count_distinct("l_partkey").alias("families"))
    x = c.join(e, "c_custkey", "left").join(funding, "c_custkey", "left").join(fam, "c_custkey", "left")
    return x.select("c_custkey", "c_name", F.coalesce("events", F.lit(0)).alias("events"), "funding", F.coalesce("families", F.lit(0)).alias("families"), "latest")


@query("""SELECT event_id, (props->>'$.k')::INT AS k FROM events ORDER BY (props->>'$.k')::INT DESC NULLS LAST, event_id LIMIT 20""")
def json_path_order(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).orderBy(F.desc_nulls_last("k"), "event_id").limit(20)


@query("""SELECT (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM orders WHERE o_orderdate >= '1997-01-01') AS recent, (SELECT count(DISTINCT c_nationkey) FROM customer) AS countries, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'F') AS funding""")
def venture_stats(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    a = c.agg(F.count("*").alias("companies"), F.count_distinct("c_nationkey").alias("countries"))
    b = o.agg(F.count_if(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("recent"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("funding"))
    return a.crossJoin(b)  # two single rows


@query("""SELECT p_brand AS topic, c_mktsegment AS institution, n_name AS country, count(*) AS works FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def topic_country_table(spark, d):
    li = t(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic")), "l_partkey")
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("institution"), F.col("n_name").alias("country"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    return li.join(o, "l_orderkey").groupBy("topic", "institution", "country").agg(F.count("*").alias("works"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate + to_days((o_orderkey % 90)::INT) <= (SELECT quantile_disc(o_orderdate, 0.6) FROM orders) GROUP BY 1""")
def corpus_as_of(spark, d):
    """Months by publication of what had been taken in by a past run: rows know both times."""
    o = t(spark, d, "orders").select("o_orderdate", F.expr("o_orderdate + make_interval(0, 0, 0, int(o_orderkey % 90))").alias("taken"))
    run = F.broadcast(o.agg(F.expr("percentile_disc(0.6) WITHIN GROUP (ORDER BY unix_micros(cast(o_orderdate AS timestamp)))").alias("run")))  # one row
    return o.crossJoin(run).where("unix_micros(cast(taken AS timestamp)) <= run").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT y, round(n / t, 6)::DOUBLE AS share FROM (SELECT year(o_orderdate)::INT AS y, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n, count(*) AS t FROM orders GROUP BY 1)""")
def member_share(spark, d):
    return t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n"), F.count("*").alias("t")).select("y", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("""SELECT w AS term, (SELECT count(*) FROM documents WHERE contains(lower(text), w)) AS docs, (SELECT count(*) FROM documents WHERE contains(lower(text), w) AND lang = 'en') AS english, (SELECT count(*) FROM benchmark WHERE contains(lower(text), w)) AS items, (SELECT count(*) FROM part WHERE contains(lower(p_name), w)) AS parts FROM (VALUES ('the'), ('tion'), ('gadget')) v(w)""")
def term_counts(spark, d):
    """Terms by where they occur: one pass over each table, all terms at once."""
    terms = ("the", "tion", "gadget")
    hits = lambda df, c: df.select("*", F.explode(F.array(*(F.when(F.lower(c).contains(w), w) for w in terms))).alias("term")).where("term IS NOT NULL")
    docs = hits(t(spark, d, "documents").select("lang", "text"), "text").groupBy("term").agg(F.count("*").alias("docs"), F.count_if(F.col("lang") == "en").alias("english"))
    items = hits(t(spark, d, "benchmark").select("text"), "text").groupBy("term").agg(F.count("*").alias("items"))
    parts = hits(t(spark, d, "part").select("p_name"), "p_name").groupBy("term").agg(F.count("*").alias("parts"))
    x = spark.createDataFrame([(w,) for w in terms], "term string").join(docs, "term", "left").join(items, "term", "left").join(parts, "term", "left")
    return x.na.fill(0)


@query("""WITH p AS (SELECT a.l_partkey % 20 AS x, b.l_partkey % 20 AS y, year(a.l_shipdate) AS yr, a.l_orderkey AS k FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey) SELECT y AS partner, count(DISTINCT k) AS total, round(count(DISTINCT k) FILTER (WHERE yr >= 1997) / count(DISTINCT k), 6)::DOUBLE AS recent FROM p WHERE x = 3 AND y <> 3 GROUP BY y""")
def partner_shares(spark, d):
    """Classes found beside one class in the same document: totals, and the part that is recent."""
    li = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 20).alias("c"), (F.year("l_shipdate") >= 1997).alias("recent"))
    own = li.where("c = 3").groupBy("l_orderkey").agg(F.bool_or("recent").alias("recent"))
    p = own.join(li.where("c <> 3").select("l_orderkey", F.col("c").alias("partner")).distinct(), "l_orderkey")
    return p.groupBy("partner").agg(F.count("*").alias("total"), F.round(F.count_if("recent") / F.count("*"), 6).alias("recent"))


@query("""WITH c AS (SELECT label, i, avg(v) AS v FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL), m AS (SELECT label, list(v ORDER BY i) AS v FROM c GROUP BY 1), s AS (SELECT vec_id, e.label, 1 - list_cosine_similarity(e.embedding::DOUBLE[], m.v) AS dist FROM embeddings e JOIN m ON m.label = 4)
SELECT vec_id, label, round(dist, 6) AS dist FROM s WHERE vec_id >= 50 AND dist < 1.2 AND label IN (4, 5, 6) ORDER BY round(dist, 9), vec_id LIMIT 12""")
def centroid_neighbours(spark, d):
    """The rows of a scope nearest to a stored centroid, under a distance gate."""
    from augury.operators.cluster import mean_vectors

    e = t(spark, d, "embeddings")
    c = F.broadcast(mean_vectors(e, ["label"], "embedding").where("label = 4").select("mean"))  # one row
    s = e.where(F.col("label").isin(4, 5, 6) & (F.col("vec_id") >= 50)).crossJoin(c).select("vec_id", "label", (1 - cosine("embedding", "mean")).alias("dist"))
    return s.where("dist < 1.2").orderBy(F.round("dist", 9), "vec_id").limit(12).select("vec_id", "label", F.round("dist", 6).alias("dist"))


@query("""WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS r FROM (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 AS hits FROM documents WHERE contains(lower(text), 'tion') AND lang = 'en')), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 9) DESC, vec_id) AS r FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en' AND vec_id <> 7),
b AS (SELECT doc_id, 'text' AS via, r FROM l WHERE r <= 50 UNION ALL SELECT doc_id, 'meaning', r FROM v WHERE r <= 50) SELECT doc_id, string_agg(via, '+' ORDER BY via) AS via, round(sum(1.0 / (60 + r)), 8)::DOUBLE AS score FROM b GROUP BY doc_id ORDER BY round(sum(1.0 / (60 + r)), 8) DESC, doc_id LIMIT 20""")
def hybrid_search(spark, d):
    """Text and meaning under the same filters, each ranked alone, joined by reciprocal ranks; via says which found it."""
    low = F.lower("text")
    docs = t(spark, d, "documents").where("lang = 'en'")
    text = docs.where(low.contains("tion")).select("doc_id", F.floor((F.length(low) - F.length(F.replace(low, F.lit("tion"), F.lit("")))) / 4).alias("s"))
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = F.broadcast(e.where("doc_id = 7").select(F.col("embedding").alias("q")))  # one row
    near = e.where("doc_id <> 7").join(docs.select("doc_id"), "doc_id", "left_semi").crossJoin(q).select("doc_id", F.round(cosine("embedding", "q"), 9).alias("s"))
    found = [best(x, [F.desc("s"), F.col("doc_id")], 50).select("doc_id", F.lit(via).alias("via"), "pos") for x, via in ((text, "text"), (near, "meaning"))]
    x = found[0].unionByName(found[1]).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("via")), "+").alias("via"), F.round(F.sum(1 / (F.col("pos") + 60)), 8).alias("score"))
    return x.orderBy(F.desc("score"), "doc_id").limit(20)


@query("""WITH h AS (SELECT o_orderkey, o_orderdate, o_orderstatus, o_custkey FROM orders WHERE o_orderpriority LIKE '2-%') SELECT 'month' AS part, strftime(o_orderdate, '%Y-%m') AS key, count(*) AS n FROM h GROUP BY 2 UNION ALL SELECT 'tier', o_orderstatus, count(*) FROM h GROUP BY 2 UNION ALL SELECT 'vertical', c_mktsegment, count(*) FROM h JOIN customer ON c_custkey = o_custkey GROUP BY 2""")
def hit_analytics(spark, d):
    """Histograms over a hit set, whole, not over its page."""
    h = t(spark, d, "orders").where(F.col("o_orderpriority").startswith("2-")).join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    x = h.select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), c.alias("key")) for p, c in (("month", F.date_format("o_orderdate", "yyyy-MM")), ("tier", F.col("o_orderstatus")), ("vertical", F.col("c_mktsegment")))))).alias("x"))
    return x.select("x.*").where("key IS NOT NULL").groupBy("part", "key").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT a.vec_id, list_sort(list(round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)))[1:20] AS ds, count(*) FILTER (WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 0.9 AND a.label = b.label) AS same, count(*) FILTER (WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 0.9) AS near FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id)
SELECT vec_id, round(ds[1], 6) AS d1, round(ds[5], 6) AS d5, round(ds[12], 6) AS d12, round(ds[20], 6) AS d20, CASE WHEN near = 0 THEN 'off_topic' WHEN same / near >= 0.5 THEN 'ok' ELSE 'ambiguous' END AS verdict FROM s""")
def query_verdicts(spark, d):
    """Each stated query's first distances and what they say of it: on a topic, between topics, or off all."""
    rows = B.usable(t(spark, d, "embeddings"), "vec_id", "embedding", F.col("label").cast("long").alias("label")).withColumn("zone", F.lit(0))

    def told(q: B.Block, x: B.Block) -> dict:
        far = 1 - B.cosines(q["v"], x["v"])
        other, near = q["id"][:, None] != x["id"][None, :], far < 0.9
        same = near & other & (q["label"][:, None] == x["label"][None, :])
        return {"q": q["id"], "near": (near & other).sum(1), "same": same.sum(1), "ds": [[v for v, _ in found] for found in B.best_first(far, x["id"], q["id"], 20)]}

    s = B.compare(rows.where("id % 50 = 0"), rows, told, "q bigint, near bigint, same bigint, ds array<double>")
    s = s.groupBy("q").agg(F.sum("near").alias("near"), F.sum("same").alias("same"), F.slice(F.array_sort(F.flatten(F.collect_list("ds"))), 1, 20).alias("ds"))
    return s.select(F.col("q").alias("vec_id"), *(F.round(F.get("ds", F.lit(i - 1)), 6).alias(f"d{i}") for i in (1, 5, 12, 20)), F.when(F.col("near") == 0, "off_topic").when(F.col("same") / F.col("near") >= 0.5, "ok").otherwise("ambiguous").alias("verdict"))
