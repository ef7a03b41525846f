"""Resolution, deduplication and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions.text import norm_title
from augury.operators import graph as G
from augury.operators import resolve as V
from augury.operators.relational import first_per_key, tolerance_join

from .catalog import query, t

_NT = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""SELECT doc_id, key FROM (SELECT doc_id, n_chars, {_NT.format('text')} AS key FROM documents) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) = 1""")
def exact_title_dedup(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "n_chars", norm_title("text").alias("key"))
    return first_per_key(docs, ["key"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "key")


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name), 1), 6) AS sim FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name), 1) >= 0.8 AND least(length(a.p_name), length(b.p_name)) >= 0.6 * greatest(length(a.p_name), length(b.p_name))""")
def fuzzy_title_dup(spark, d):
    return V.fuzzy_pairs(t(spark, d, "part"), "p_partkey", "p_name", ["p_brand"], 0.8).withColumn("sim", F.round("sim", 6))


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN (SELECT s_nationkey, any_value(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey HAVING count(*) = 1) ON c_nationkey = s_nationkey""")
def unique_name_match(spark, d):
    u = V.unique_keys(t(spark, d, "supplier"), "s_nationkey", "s_suppkey")
    return t(spark, d, "customer").join(u, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "s_suppkey")


@query("""WITH u AS (SELECT s_nationkey AS k, any_value(s_suppkey) AS m FROM supplier GROUP BY ALL HAVING count(*) = 1), w AS (SELECT floor(s_acctbal / 500)::BIGINT AS k, any_value(s_suppkey) AS m FROM supplier GROUP BY ALL HAVING count(*) = 1)
SELECT c_custkey, coalesce(s.s_suppkey, u.m, w.m) AS match, CASE WHEN s.s_suppkey IS NOT NULL THEN 'anchor' WHEN u.m IS NOT NULL THEN 'nation' WHEN w.m IS NOT NULL THEN 'balance' ELSE 'new' END AS stage
FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey LEFT JOIN u ON u.k = c_nationkey LEFT JOIN w ON w.k = floor(c_acctbal / 500)::BIGINT""")
def cascade_resolution(spark, d):
    s = t(spark, d, "supplier").withColumn("band", F.floor(F.col("s_acctbal") / 500))
    c = t(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("anchor"), "c_nationkey", F.floor(F.col("c_acctbal") / 500).alias("band"))
    stages = {"anchor": ("anchor", s.select("s_suppkey", F.col("s_suppkey").alias("m"))), "nation": ("c_nationkey", V.unique_keys(s, "s_nationkey", "s_suppkey")), "balance": ("band", V.unique_keys(s, "band", "s_suppkey"))}
    return V.cascade(c, "c_custkey", stages)


_STORY = """o AS (SELECT o_orderkey AS id, o_custkey AS k, floor(epoch(o_orderdate))::BIGINT // 86400 AS day FROM orders), e AS (SELECT a.id AS u, b.id AS v FROM o a JOIN o b ON a.k = b.k AND a.id <> b.id AND abs(a.day - b.day) <= 30)"""


@query(f"""WITH RECURSIVE {_STORY}, r AS (SELECT u, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.u) SELECT u AS node, min(c) AS component FROM r GROUP BY u""")
def story_components(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"))
    a, b = (o.select("o_custkey", F.col("o_orderkey").alias(k), F.col("day").alias(f"d{k}")) for k in "ab")
    return G.components(tolerance_join(a, b, "o_custkey", "da", "db", 30).where("a < b").select("a", "b").distinct())


@query("""WITH RECURSIVE b AS (SELECT min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders), c AS (SELECT k, y, (SELECT count(*) FROM orders WHERE o_custkey = k AND year(o_orderdate) = y) AS n
FROM (SELECT DISTINCT o_custkey AS k FROM orders), (SELECT unnest(range(lo, hi + 1)) AS y FROM b)),
p AS (SELECT k, y, 0.0::DOUBLE AS now, 0.0::DOUBLE AS before, n, 0::BIGINT AS nb FROM c, b WHERE y = lo
UNION ALL SELECT c.k, c.y, ln(1 + p.n * exp(p.now) + p.nb * exp(p.before)), p.now, c.n, p.n FROM p JOIN c ON c.k = p.k AND c.y = p.y + 1)
SELECT o_orderkey AS node, round(now, 6) AS logn FROM orders JOIN p ON k = o_custkey AND y = year(o_orderdate)""")
def dag_path_counts(spark, d):
    """Layers are years, as many as the data have; each order cites its customer's orders of the two years before."""
    n = t(spark, d, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey", F.year("o_orderdate").alias("layer"))
    x = n.select("o_custkey", F.col("node").alias("src"), F.explode(F.array(F.col("layer") - 1, F.col("layer") - 2)).alias("layer"))
    edges = x.join(n.withColumnRenamed("node", "dst"), ["o_custkey", "layer"]).select("src", "dst")
    return G.log_path_counts(n.select("node", "layer"), edges).select("node", F.round("logn", 6).alias("logn"))


@query("""SELECT p_brand, count(*) AS lines, round(avg(l_quantity), 4) AS mean_q, quantile_cont(datediff('day', o_orderdate, l_shipdate), 0.5) AS median_age, arg_min(l_orderkey, (-l_extendedprice, l_orderkey)) AS hub FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY p_brand""")
def citation_metrics(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("p_brand").agg(F.count("*").alias("lines"), F.round(F.avg("l_quantity"), 4).alias("mean_q"), F.percentile(F.datediff("l_shipdate", "o_orderdate"), 0.5).alias("median_age"), F.min_by("l_orderkey", F.struct(-F.col("l_extendedprice"), F.col("l_orderkey"))).alias("hub"))


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i FROM documents) ORDER BY (i > 2)::INT, n_chars DESC, doc_id LIMIT 60""")
def source_cap_topup(spark, d):
    return V.capped_then_topped_up(t(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 2, 60).select("doc_id", "source")


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS head, bool_or(o_orderstatus = 'F') AS cited, count(*) AS members FROM orders GROUP BY o_custkey""")
def family_collapse(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("head"), F.bool_or(F.col("o_orderstatus") == "F").alias("cited"), F.count("*").alias("members"))


@query("""SELECT a.c_custkey AS a, b.s_suppkey AS b FROM customer a JOIN supplier b ON floor(a.c_acctbal / 100) = floor(b.s_acctbal / 100) AND (CASE WHEN a.c_nationkey < 5 THEN NULL ELSE a.c_nationkey END IS NULL OR a.c_nationkey = b.s_nationkey)""")
def geo_compatible_match(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_acctbal") / 100).alias("band"), F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("geo"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("b"), F.floor(F.col("s_acctbal") / 100).alias("band"), "s_nationkey")
    return c.join(s, "band").where("geo IS NULL OR geo = s_nationkey").select("a", "b")
