"""Pages of the product that put several lookups together: a class, a work, its neighbours, nests in space, leads, filtered lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.lineage import cut
from augury.functions.text import slug
from augury.functions.vectors import cosine, doubles, unit
from augury.operators import filters as L
from augury.operators import search as S
from augury.operators.cluster import mean_vectors
from augury.operators.relational import first_per_key
from augury.operators.search import top_k
from augury.operators.series import rank_in_parts

from .catalog import query, t
from .search import _STEMMED, text_index
from .vectors import _CENTRES, _COS, centres

_CLASS = """(SELECT l_orderkey, l_quantity::DOUBLE AS qty, l_returnflag, l_shipdate, p_type, p_size, s_suppkey, o_orderdate, year(o_orderdate)::INT AS y, c_mktsegment, n_name
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE p_brand = 'Brand#13')"""


@query(f"""WITH c AS (SELECT * FROM {_CLASS})
SELECT 'holders' AS block, s_suppkey::VARCHAR AS a, NULL AS b, v FROM (SELECT s_suppkey, count(DISTINCT l_orderkey)::DOUBLE AS v FROM c GROUP BY 1 ORDER BY v DESC, s_suppkey LIMIT 10)
UNION ALL SELECT 'sectors', c_mktsegment, y::VARCHAR, count(DISTINCT l_orderkey)::DOUBLE FROM c WHERE y BETWEEN 1993 AND 1997 GROUP BY ALL
UNION ALL SELECT 'lag', y::VARCHAR, NULL, round(median(date_diff('day', o_orderdate, l_shipdate)), 4) FROM c WHERE y BETWEEN 1993 AND 1997 GROUP BY y
UNION ALL SELECT 'survival', y::VARCHAR, NULL, round(count(*) FILTER (WHERE l_returnflag = 'N') / count(*), 6) FROM c GROUP BY y
UNION ALL SELECT 'countries', n_name, y::VARCHAR, count(DISTINCT l_orderkey)::DOUBLE FROM c GROUP BY ALL
UNION ALL SELECT 'offices', y::VARCHAR, NULL, count(*)::DOUBLE FROM (SELECT y, l_orderkey FROM c GROUP BY ALL HAVING count(DISTINCT s_suppkey) > 1) GROUP BY y
UNION ALL SELECT 'pairs', s_suppkey::VARCHAR, c_mktsegment, v FROM (SELECT s_suppkey, c_mktsegment, count(DISTINCT l_orderkey)::DOUBLE AS v FROM c GROUP BY ALL ORDER BY v DESC, s_suppkey, c_mktsegment LIMIT 3)
UNION ALL SELECT 'groups', p_type, y::VARCHAR, count(DISTINCT l_orderkey)::DOUBLE FROM c GROUP BY ALL
UNION ALL SELECT 'branches', p_size::VARCHAR, NULL, v FROM (SELECT p_size, sum(qty) AS v FROM c GROUP BY 1 ORDER BY v DESC, p_size LIMIT 3)
UNION ALL SELECT 'events', l_returnflag, y::VARCHAR, count(*)::DOUBLE FROM c WHERE l_returnflag IN ('A', 'R') GROUP BY ALL""")
def class_page(spark, d):
    """Ten lookups for one class, from one narrow join that is written once: holders, sectors, lags, survival, countries, offices, pairs, groups,
    branches and events."""
    part = t(spark, d, "part").where("p_brand = 'Brand#13'").select("p_partkey", "p_type", "p_size")
    c = (t(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")))
    c = cut(c.select("l_orderkey", F.col("l_quantity").cast("double").alias("qty"), "l_returnflag", F.datediff("l_shipdate", "o_orderdate").alias("lag"), "p_type", "p_size", "s_suppkey", F.year("o_orderdate").alias("y"), "c_mktsegment", "n_name"), "class")
    works, recent, none = F.count_distinct("l_orderkey").cast("double"), F.col("y").between(1993, 1997), F.lit(None).cast("string")
    several = c.groupBy("y", "l_orderkey").agg(F.count_distinct("s_suppkey").alias("n")).where("n > 1")
    best = lambda df, n, *by: df.orderBy(F.desc("v"), *by).limit(n)
    blocks = {
        "holders": (best(c.groupBy("s_suppkey").agg(works.alias("v")), 10, "s_suppkey"), "s_suppkey", None),
        "sectors": (c.where(recent).groupBy("c_mktsegment", "y").agg(works.alias("v")), "c_mktsegment", "y"),
        "lag": (c.where(recent).groupBy("y").agg(F.round(F.percentile("lag", 0.5), 4).alias("v")), "y", None),
        "survival": (c.groupBy("y").agg(F.round(F.count_if(F.col("l_returnflag") == "N") / F.count("*"), 6).alias("v")), "y", None),
        "countries": (c.groupBy("n_name", "y").agg(works.alias("v")), "n_name", "y"),
        "offices": (several.groupBy("y").agg(F.count("*").cast("double").alias("v")), "y", None),
        "pairs": (best(c.groupBy("s_suppkey", "c_mktsegment").agg(works.alias("v")), 3, "s_suppkey", "c_mktsegment"), "s_suppkey", "c_mktsegment"),
        "groups": (c.groupBy("p_type", "y").agg(works.alias("v")), "p_type", "y"),
        "branches": (best(c.groupBy("p_size").agg(F.sum("qty").alias("v")), 3, "p_size"), "p_size", None),
        "events": (c.where(F.col("l_returnflag").isin("A", "R")).groupBy("l_returnflag", "y").agg(F.count("*").cast("double").alias("v")), "l_returnflag", "y"),
    }
    out = None
    for name, (df, a, b) in blocks.items():
        one = df.select(F.lit(name).alias("block"), F.col(a).cast("string").alias("a"), (F.col(b).cast("string") if b else none).alias("b"), "v")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH h AS (SELECT d.doc_id, d.n_chars FROM {_STEMMED} s JOIN documents d USING (doc_id) WHERE list_contains(s.w, 'the') AND list_contains(s.w, 'and') AND d.n_chars >= 400)
SELECT 'cited' AS sorting, doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id DESC)::INT AS rank FROM h QUALIFY rank <= 20 UNION ALL SELECT 'recent', doc_id, row_number() OVER (ORDER BY doc_id DESC)::INT AS rank FROM h QUALIFY rank <= 20""")
def work_search(spark, d):
    """Works that hold all stems, from the index, within a bound, by size and by age: a page of each."""
    found = text_index(spark, d).matching(["the", "and"]).withColumnRenamed("id", "doc_id")
    h = t(spark, d, "documents").select("doc_id", "n_chars").where("n_chars >= 400").join(found, "doc_id", "left_semi")
    pages = [top_k(h.select("doc_id", s.alias("score"), (-F.col("doc_id")).alias("_d")), 20, "_d").select(F.lit(n).alias("sorting"), "doc_id", "rank") for n, s in (("cited", F.col("n_chars")), ("recent", F.col("doc_id")))]
    return pages[0].unionByName(pages[1])


@query(f"""WITH h AS (SELECT doc_id, source FROM {_STEMMED} WHERE list_contains(w, 'the') AND list_contains(w, 'with')), s AS (SELECT source FROM h ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 300), f AS (SELECT source AS field, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, field LIMIT 5)
SELECT field, n, (SELECT least(count(*), 501) FROM h) AS hits, round(n / sum(n) OVER (), 6) AS share FROM f""")
def hit_fields(spark, d):
    """How hits spread over fields, from a sample by hash (the feature is the sample), with their number counted to 500 and one."""
    docs = t(spark, d, "documents").select("doc_id", "source").join(text_index(spark, d).matching(["the", "with"]).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sample = docs.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(300)
    fields = sample.groupBy(F.col("source").alias("field")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(5)
    hits = F.broadcast(docs.limit(501).agg(F.count("*").alias("hits")))  # one row
    return fields.crossJoin(hits).select("field", "n", "hits", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 6).alias("share"))  # five rows


_SIZED = f"(SELECT c.label, c.c, n, first FROM ({_CENTRES}) c JOIN (SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY label) USING (label))"


def sized_classes(spark, d):
    """The ten classes' centres with what they hold."""
    sizes = t(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    return centres(spark, d).join(sizes, "label")


@query(f"""SELECT label, n, round(1 - {_COS}, 6) AS dist FROM (SELECT embedding FROM embeddings WHERE vec_id = 7), {_SIZED} c WHERE n >= (SELECT avg(n) FROM {_SIZED}) ORDER BY round(1 - {_COS}, 9), label LIMIT 4""")
def nearest_sized_classes(spark, d):
    """The classes nearest to a vector among those with rows enough."""
    q = F.broadcast(t(spark, d, "embeddings").where("vec_id = 7").select("embedding"))  # one row
    c = sized_classes(spark, d)
    enough = F.broadcast(c.agg(F.avg("n").alias("enough")))  # one row
    s = c.crossJoin(enough).where("n >= enough").crossJoin(q).withColumn("dist", 1 - cosine("embedding", "c"))
    return s.orderBy(F.round("dist", 9), "label").limit(4).select("label", "n", F.round("dist", 6).alias("dist"))


@query(f"""WITH s AS (SELECT e.vec_id, e.label AS own, c.label, n, first, 1 - {_COS} AS dist FROM embeddings e, {_SIZED} c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), label) AS rank FROM s)
SELECT vec_id, rank::INT AS rank, label, n, first, round(dist, 6) AS dist, CASE WHEN dist >= 0.9 THEN 'off' WHEN label = own THEN 'ok' ELSE 'other' END AS verdict FROM r WHERE rank <= 3""")
def gated_classes(spark, d):
    """Every row's three nearest classes with their payload, and what a gate on the distance says."""
    c = F.broadcast(sized_classes(spark, d).withColumnRenamed("label", "class"))  # ten rows
    s = t(spark, d, "embeddings").crossJoin(c).select("vec_id", F.col("label").alias("own"), "class", "n", "first", (1 - cosine("embedding", "c")).alias("dist"))
    near = F.slice(F.array_sort(F.collect_list(F.struct(F.round("dist", 9).alias("o"), F.col("class").alias("label"), "n", "first", "dist"))), 1, 3)
    x = s.groupBy("vec_id", "own").agg(near.alias("near")).select("vec_id", "own", F.posexplode("near").alias("i", "x")).select("vec_id", "own", (F.col("i") + 1).alias("rank"), "x.label", "x.n", "x.first", "x.dist")
    verdict = F.when(F.col("dist") >= 0.9, "off").when(F.col("label") == F.col("own"), "ok").otherwise("other")
    return x.select("vec_id", "rank", "label", "n", "first", F.round("dist", 6).alias("dist"), verdict.alias("verdict"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2)::DOUBLE AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey, c_name, n_name, coalesce(lines, 0) AS lines, total, row_number() OVER (ORDER BY coalesce(lines, 0) DESC, o_orderkey)::INT AS rank FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN c ON l_orderkey = o_orderkey WHERE o_orderkey IN (1, 7, 32, 100, 1000, 4711, 99999999)""")
def works_by_id(spark, d):
    """A list of ids with three lookups that may find nothing, most cited first."""
    o = t(spark, d, "orders").where(F.col("o_orderkey").isin(1, 7, 32, 100, 1000, 4711, 99999999))
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).cast("double").alias("total"))
    x = o.join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    x = x.select("o_orderkey", "c_name", "n_name", F.coalesce("lines", F.lit(0)).alias("lines"), "total")
    return x.withColumn("rank", F.row_number().over(W.orderBy(F.desc("lines"), "o_orderkey")))  # seven rows at most


@query("""WITH m AS (SELECT p_type, p_brand, min(date_diff('month', DATE '1992-01-01', l_shipdate)) AS first, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), l AS (SELECT a.p_type, a.n + b.n AS n, b.first - a.first AS lead FROM m a JOIN m b ON b.p_type = a.p_type AND a.p_brand = 'Brand#11' AND b.p_brand = 'Brand#22')
SELECT CASE WHEN n >= 20 THEN p_type END AS name, n, lead::INT AS lead FROM l WHERE lead <> 0 ORDER BY name IS NULL, lead DESC, n DESC, p_type LIMIT 12""")
def reliable_leads(spark, d):
    """By how many months one brand was ahead of another in a type: named where the numbers bear it, those first."""
    x = t(spark, d, "lineitem").select("l_partkey", "l_shipdate").join(t(spark, d, "part").where("p_brand IN ('Brand#11', 'Brand#22')").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1 - 1992 * 12
    m = x.groupBy("p_type", "p_brand").agg(F.min(month).alias("first"), F.count("*").alias("n"))
    side = lambda brand, i: m.where(F.col("p_brand") == brand).select("p_type", F.col("first").alias(f"f{i}"), F.col("n").alias(f"n{i}"))
    lead = side("Brand#11", 0).join(side("Brand#22", 1), "p_type").select("p_type", (F.col("n0") + F.col("n1")).alias("n"), (F.col("f1") - F.col("f0")).cast("int").alias("lead")).where("lead <> 0")
    named = lead.withColumn("name", F.when(F.col("n") >= 20, F.col("p_type")))
    return named.orderBy(F.col("name").isNull(), F.desc("lead"), F.desc("n"), "p_type").limit(12).select("name", "n", "lead")


@query("""WITH c AS (SELECT label, i, avg(v) AS v FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL), p AS (SELECT label, max(v) FILTER (WHERE i = 1) AS x, max(v) FILTER (WHERE i = 2) AS y, max(v) FILTER (WHERE i = 3) AS z FROM c GROUP BY label),
m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM p), s AS (SELECT quantile_cont(greatest(abs(x - mx), abs(y - my), abs(z - mz)), 0.9) AS s FROM p, m), n AS (SELECT label, (vec_id % 12)::INT AS month, count(*) AS n FROM embeddings GROUP BY ALL)
SELECT p.label, round((x - mx) / s, 5) AS x, round((y - my) / s, 5) AS y, round((z - mz) / s, 5) AS z, (SELECT string_agg(coalesce(n.n, 0)::VARCHAR, ',' ORDER BY g.month) FROM (SELECT unnest(range(12)) AS month) g LEFT JOIN n ON n.month = g.month AND n.label = p.label) AS series FROM p, m, s""")
def nest_space(spark, d):
    """Nests' centres in a frame that nine tenths of them fill, about their medians, with their months, empty ones too."""
    e = t(spark, d, "embeddings")
    p = mean_vectors(e, ["label"], "embedding").select("label", *(F.col("mean")[i].alias(c) for i, c in enumerate("xyz")))
    mid = F.broadcast(p.agg(*(F.percentile(c, 0.5).alias(f"m{c}") for c in "xyz")))  # one row
    p = p.crossJoin(mid).select("label", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"))
    size = F.broadcast(p.agg(F.percentile(F.greatest(*(F.abs(c) for c in "xyz")), 0.9).alias("s")))  # one row
    counts = e.groupBy("label", (F.col("vec_id") % 12).cast("int").alias("month")).agg(F.count("*").alias("n")).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("by"))
    series = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: F.coalesce(F.try_element_at("by", m), F.lit(0)).cast("string")), ",")
    return p.crossJoin(size).join(counts, "label").select("label", *(F.round(F.col(c) / F.col("s"), 5).alias(c) for c in "xyz"), series.alias("series"))


@query(f"""WITH s AS (SELECT e.vec_id, e.label, {_COS} AS s, n_chars, source FROM embeddings e JOIN ({_CENTRES}) c ON c.label = e.label LEFT JOIN documents ON doc_id = e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS i FROM s),
m AS (SELECT label, source FROM (SELECT label, source, count(*) AS n FROM s WHERE source IS NOT NULL GROUP BY label, source) QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, source) = 1)
SELECT r.label, count(*) AS size, string_agg(vec_id::VARCHAR, ',' ORDER BY i) FILTER (WHERE i <= 3) AS central, any_value(m.source) AS leading_source, round(avg(n_chars), 4) AS mean_chars, round(median(n_chars), 4)::DOUBLE AS median_chars FROM r LEFT JOIN m USING (label) GROUP BY r.label""")
def cluster_profiles(spark, d):
    """Clusters with their three most central members, their leading source and what their members' texts measure."""
    e = t(spark, d, "embeddings").join(F.broadcast(centres(spark, d)), "label").select("vec_id", "label", F.round(cosine("embedding", "c"), 9).alias("s"))
    s = e.join(t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars", "source"), "vec_id", "left")
    central = first_per_key(e, ["label"], [F.desc("s"), F.col("vec_id")], 3).groupBy("label").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "vec_id"))).alias("xs"))
    mode = first_per_key(s.where("source IS NOT NULL").groupBy("label", "source").agg(F.count("*").alias("n")), ["label"], [F.desc("n"), F.col("source")]).select("label", F.col("source").alias("leading_source"))
    figures = s.groupBy("label").agg(F.count("*").alias("size"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.percentile("n_chars", 0.5), 4).alias("median_chars"))
    return figures.join(central, "label").join(mode, "label", "left").select("label", "size", F.array_join(F.transform("xs", lambda x: x["vec_id"].cast("string")), ",").alias("central"), "leading_source", "mean_chars", "median_chars")


@query("""WITH q AS (SELECT o_orderpriority AS src, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, o_custkey AS s FROM orders), e AS (SELECT s FROM q WHERE q BETWEEN 1995 * 4 AND 1995 * 4 + 1 GROUP BY s), l AS (SELECT s FROM q WHERE q BETWEEN 2001 * 4 AND 2001 * 4 + 1 GROUP BY s), p AS (SELECT s FROM e INTERSECT SELECT s FROM l),
n AS (SELECT src, q, count(*) AS n FROM q JOIN p USING (s) GROUP BY ALL) SELECT src, q::INT AS quarter, n, round(n / sum(n) OVER (PARTITION BY q), 6) AS share FROM n""")
def quarter_panel_share(spark, d):
    """Shares by quarter inside a fixed panel: the sources that deliver both early and late."""
    q = t(spark, d, "orders").select(F.col("o_orderpriority").alias("src"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("quarter"), F.col("o_custkey").alias("s"))
    at = lambda y: q.where(F.col("quarter").between(y * 4, y * 4 + 1)).select("s")
    n = q.join(at(1995).intersect(at(2001)), "s", "left_semi").groupBy("src", "quarter").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("quarter")), 6))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS u, 1000000 + l_suppkey AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1 AS dense FROM (SELECT u AS id FROM e UNION SELECT v FROM e)) SELECT a.dense AS u, b.dense AS v FROM e JOIN n a ON a.id = e.u JOIN n b ON b.id = e.v""")
def dense_edges(spark, d):
    """An edge list on gapless ids, numbered in parts by a hash so that no task numbers all nodes."""
    e = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").cast("long").alias("u"), (F.col("l_suppkey") + 1000000).cast("long").alias("v")).distinct()
    e = cut(e, "edges")
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct().withColumn("h", F.md5(F.col("id").cast("string")))
    dense = cut(rank_in_parts(nodes, [], "h", ["id"], "dense").select("id", "dense"), "nodes")
    end = lambda c: dense.select(F.col("id").alias(c), F.col("dense").alias(f"{c}_dense"))
    return e.join(end("u"), "u").join(end("v"), "v").select(F.col("u_dense").alias("u"), F.col("v_dense").alias("v"))


@query("""WITH v AS (SELECT vec_id, string_split(trim(embedding::VARCHAR, '[]'), ', ') AS said FROM embeddings), x AS (SELECT vec_id, [s::DOUBLE for s in said] AS v FROM v) SELECT vec_id, len(v)::INT AS dims, round(v[1] / sqrt(list_sum([y * y for y in v])), 5) AS first, round(list_max(v) / sqrt(list_sum([y * y for y in v])), 5) AS top FROM x""")
def vectors_from_text(spark, d):
    """Vectors that come as text, '[f1, f2]', parsed and brought to unit length."""
    said = t(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("said"))
    v = said.select("vec_id", unit(doubles(F.transform(F.split(F.translate("said", "[] ", ""), ","), lambda x: x.cast("double")))).alias("v"))
    return v.select("vec_id", F.size("v").alias("dims"), F.round(F.col("v")[0], 5).alias("first"), F.round(F.array_max("v"), 5).alias("top"))


@query("""SELECT doc_id, md5(regexp_extract(left(text, 340), '^.*[^ \t-\r]', 0, 's')) AS clipped_md5, length(text) > 340 AS cut FROM documents WHERE text IS NOT NULL AND regexp_matches(left(text, 340), '[^ \t-\r]')""")
def clipped_to_budget(spark, d):
    """Texts cut to what a budget of a hundred tokens holds at 3.4 characters a token, without white space at the end."""
    head = F.regexp_replace(F.substring("text", 1, 340), r"[ \t-\r]+$", "")
    x = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", head.alias("head"), (F.length("text") > 340).alias("cut"))
    return x.where("head <> ''").select("doc_id", F.md5("head").alias("clipped_md5"), "cut")


LISTS = L.Allowed(facets={"status": ["O", "F", "P"], "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, sorts={"date_desc": ["-o_orderdate"], "price_desc": ["-o_totalprice", "o_orderdate"]}, windows={"year": 365, "all": None}, default_sort="date_desc")
ASKED = {"status": "o,p,nonsense", "priority": "2-high", "without": "7,8", "least": "12abc", "window": "year", "sort": "price_desc", "view": "list", "page": "2"}


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderdate NULLS LAST, o_orderkey DESC)::INT AS pos FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '2-HIGH' AND o_custkey::VARCHAR NOT IN ('7', '8') AND floor(o_totalprice / 5000) >= 12 AND date_diff('day', o_orderdate, DATE '1998-08-02') < 365 QUALIFY pos BETWEEN 51 AND 100""")
def filtered_page(spark, d):
    """A list as a page's address asks for it: facets in any case, unknown values dropped, numbers read as far as they are numbers."""
    f = L.parse(ASKED, LISTS)
    o = t(spark, d, "orders").withColumns({"buyer": F.col("o_custkey").cast("string"), "score": F.floor(F.col("o_totalprice") / 5000)})
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    hits = o.where(L.predicate(f, {"status": "o_orderstatus", "priority": "o_orderpriority"}, source="buyer", score="score", age_days=age, text="buyer"))
    rows = L.page(hits, f, LISTS, "o_orderkey").select("o_orderkey", "o_totalprice", "o_orderdate")
    within = F.row_number().over(W.orderBy(F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderdate"), F.desc("o_orderkey")))  # a page's rows
    return rows.select("o_orderkey", (within + f.offset).cast("int").alias("pos"))


_NEAR7 = "SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS s FROM embeddings WHERE vec_id <> 7"
_WITHIN = f"""WITH keep AS (SELECT doc_id FROM documents WHERE lang = '{{lang}}' AND n_chars >= 500), near AS (SELECT vec_id, s FROM ({_NEAR7}) ORDER BY round(s, 9) DESC, vec_id LIMIT 60), inside AS (SELECT * FROM near WHERE vec_id IN (SELECT doc_id FROM keep)),
words AS (SELECT doc_id FROM {_STEMMED} WHERE list_contains(w, 'la') OR list_contains(w, 'the')), more AS (SELECT vec_id, s FROM ({_NEAR7}) WHERE (SELECT count(*) FROM inside) < 12 AND vec_id IN (SELECT doc_id FROM keep) AND vec_id IN (SELECT doc_id FROM words)),
meaning AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS r FROM (SELECT * FROM inside UNION SELECT * FROM more) QUALIFY r <= 36),
text AS (SELECT doc_id, row_number() OVER (ORDER BY round(ln(1 + len(list_filter(w, lambda y: y = 'la'))), 6) DESC, doc_id) AS r FROM {_STEMMED} WHERE list_contains(w, 'la') AND doc_id IN (SELECT doc_id FROM keep) QUALIFY r <= 36)
SELECT '{{lang}}' AS lang, doc_id, string_agg(via, '+' ORDER BY via) AS via, round(sum(1.0 / (60 + r)), 8)::DOUBLE AS score FROM (SELECT doc_id, r, 'text' AS via FROM text UNION ALL SELECT doc_id, r, 'meaning' FROM meaning) GROUP BY doc_id ORDER BY round(sum(1.0 / (60 + r)), 8) DESC, doc_id LIMIT 12"""


@query(f"SELECT * FROM ({_WITHIN.format(lang='fr')}) UNION ALL SELECT * FROM ({_WITHIN.format(lang='en')})")
def hybrid_within_filter(spark, d):
    """Text and meaning under a filter, fused by ranks. Where too few of the nearest neighbours pass, those of the filter that hold one of the query's words stand in: so it is for the
    rarer language, not for the other."""
    index, docs = text_index(spark, d), t(spark, d, "documents")
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = F.broadcast(e.where("doc_id = 7").select(F.col("embedding").alias("q")))  # one row
    vectors, words = e.where("doc_id <> 7").crossJoin(q), index.any_of(["la", "the"]).withColumnRenamed("id", "doc_id")
    out = None
    for lang in ("fr", "en"):
        keep = docs.where((F.col("lang") == lang) & (F.col("n_chars") >= 500)).select("doc_id")
        near, _ = S.meaning_within(vectors, keep, words, "doc_id", F.round(cosine("embedding", "q"), 9), 60, 12, 36)
        text = index.scores(["la"]).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).join(keep, "doc_id", "left_semi")
        ranked = [top_k(df, 36, "doc_id").select("doc_id", F.lit(via).alias("via"), "rank") for df, via in ((near, "meaning"), (text, "text"))]
        fused = ranked[0].unionByName(ranked[1]).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("via")), "+").alias("via"), F.round(F.sum(1 / (F.col("rank") + 60)), 8).alias("score"))
        page = fused.orderBy(F.desc("score"), "doc_id").limit(12).select(F.lit(lang).alias("lang"), "doc_id", "via", "score")
        out = page if out is None else out.unionByName(page)
    return out


@query("""WITH w AS (SELECT (vec_id % 2)::INT AS win, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT win, label, i, avg(v) AS v FROM w GROUP BY ALL), l AS (SELECT win, label, list(v ORDER BY i) AS v FROM m GROUP BY ALL), n AS (SELECT (vec_id % 2)::INT AS win, label, count(*) AS n FROM embeddings GROUP BY ALL),
e AS (SELECT a.label AS a, b.label AS b, list_cosine_similarity(a.v, b.v) AS s FROM l a JOIN l b ON a.win = 0 AND b.win = 1 AND list_cosine_similarity(a.v, b.v) >= 0.05)
SELECT 'run' AS part, count(*)::VARCHAR AS a, (SELECT count(*) FROM e)::VARCHAR AS b, sum(n)::DOUBLE AS v FROM n UNION ALL SELECT 'node', win || ':' || label, NULL, n::DOUBLE FROM n UNION ALL SELECT 'edge', '0:' || a, '1:' || b, round(s, 6) FROM e""")
def lineage_page(spark, d):
    """A run of two windows: how many nodes and edges it has, its nodes with what they hold, and the edges between windows."""
    m = mean_vectors(t(spark, d, "embeddings").withColumn("win", F.col("vec_id") % 2), ["win", "label"], "embedding")
    m = cut(m.select("win", "label", "mean", F.col("n").cast("double").alias("n")), "lineage")
    name = F.concat_ws(":", F.col("win").cast("string"), F.col("label").cast("string"))
    a, b = (m.where(F.col("win") == i).select(name.alias(k), F.col("mean").alias(f"m{k}")) for i, k in enumerate("ab"))
    edges = cut(a.crossJoin(F.broadcast(b)).withColumn("v", cosine("ma", "mb")).where("v >= 0.05").select("a", "b", F.round("v", 6).alias("v")), "lineage-edges")  # ten centres a window
    none, text = F.lit(None).cast("string"), lambda c: c.cast("string")
    run = m.agg(text(F.count("*")).alias("a"), F.sum("n").alias("v")).crossJoin(edges.agg(text(F.count("*")).alias("b")))  # one row each
    return run.select(F.lit("run").alias("part"), "a", "b", "v").unionByName(m.select(F.lit("node").alias("part"), name.alias("a"), none.alias("b"), F.col("n").alias("v"))).unionByName(edges.select(F.lit("edge").alias("part"), "a", "b", "v"))


@query("""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, p_size FROM part)
SELECT slug, max(p_partkey) AS newest, count(*) AS n FROM s WHERE slug IN ('red-widget', 'small-ring', 'blue-bolt', 'no-such-thing') AND p_size < 30 GROUP BY slug""")
def slugs_in_window(spark, d):
    """A list of slugs looked up inside a window: the newest of each, and how many there are."""
    s = t(spark, d, "part").where("p_size < 30").select("p_partkey", slug("p_name").alias("slug"))
    asked = spark.createDataFrame([(x,) for x in ("red-widget", "small-ring", "blue-bolt", "no-such-thing")], "slug string")
    return s.join(F.broadcast(asked), "slug", "left_semi").groupBy("slug").agg(F.max("p_partkey").alias("newest"), F.count("*").alias("n"))  # four rows


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT (label % 3)::INT AS grp, sum(n)::BIGINT AS size, string_agg(label || '=' || n, ' ' ORDER BY n DESC, label) AS nests, row_number() OVER (ORDER BY sum(n) DESC, label % 3)::INT AS pos FROM n GROUP BY label % 3""")
def nests_by_group(spark, d):
    """Nests under their groups as they are shown: groups by what they hold, nests in a group likewise."""
    n = t(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    g = n.groupBy((F.col("label") % 3).alias("grp")).agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "label"))).alias("xs"))  # a row a nest
    nests = F.array_join(F.transform("xs", lambda x: F.concat(x["label"].cast("string"), F.lit("="), (-x["o"]).cast("string"))), " ")
    return g.select("grp", "size", nests.alias("nests"), F.row_number().over(W.orderBy(F.desc("size"), "grp")).alias("pos"))
