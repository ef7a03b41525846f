"""Rules, samples and row-level grounding checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.text import words
from augury.operators import sampling as P
from augury.operators.relational import first_per_key

from .catalog import query, t

_W = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


@query("""SELECT o_orderkey FROM orders WHERE (o_orderkey * 2654435761) % 4294967296 < 429496729""")
def bernoulli_sample(spark, d):
    return P.bernoulli(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.1)


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS r FROM documents) WHERE r <= 10""")
def stratified_sample(spark, d):
    return P.stratified(t(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 40)


@query("""SELECT p_partkey, CASE WHEN i = 1 THEN p_type ELSE p_type || ' ' || i END AS label FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM part)""")
def label_uniquify(spark, d):
    i = F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey"))
    return t(spark, d, "part").withColumn("i", i).select("p_partkey", F.when(F.col("i") == 1, F.col("p_type")).otherwise(F.concat_ws(" ", "p_type", "i")).alias("label"))


@query("""WITH r(rule, allow) AS (VALUES ('/', TRUE), ('/en', FALSE), ('/en/2', TRUE), ('/fr', FALSE), ('/de/1', FALSE)), p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, coalesce(arg_max(allow, length(rule)), TRUE) AS allowed FROM p LEFT JOIN r ON starts_with(path, rule) GROUP BY page_id""")
def longest_rule_wins(spark, d):
    rules = F.broadcast(spark.createDataFrame([("/", True), ("/en", False), ("/en/2", True), ("/fr", False), ("/de/1", False)], "rule string, allow boolean"))  # five rules
    p = t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("path"))
    hit = p.join(rules, F.col("path").startswith(F.col("rule")), "left")
    return hit.groupBy("page_id").agg(F.coalesce(F.max_by("allow", F.length("rule")), F.lit(True)).alias("allowed"))


@query("""SELECT a.o_orderkey, CASE WHEN b.p_name IS NULL THEN a.name WHEN starts_with(a.name, b.p_name) THEN a.name ELSE b.p_name END AS kept FROM (SELECT o_orderkey, o_orderkey % 200 AS k, o_orderpriority || ' long form' AS name FROM orders) a LEFT JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '1-URGENT' END AS p_name FROM part) b USING (k)""")
def field_merge(spark, d):
    a = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 200).alias("k"), F.concat("o_orderpriority", F.lit(" long form")).alias("name"))
    b = t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("1-URGENT").alias("new"))
    kept = F.when(F.col("new").isNull() | F.col("name").startswith(F.col("new")), F.col("name")).otherwise(F.col("new"))  # ours stays when the new one is its beginning
    return a.join(b, "k", "left").select("o_orderkey", kept.alias("kept"))


@query("""SELECT user_id, count(DISTINCT ts::DATE) AS nights, count(DISTINCT ts::DATE) >= 3 AS fires FROM events WHERE event_type = 'error' GROUP BY user_id""")
def failing_nights(spark, d):
    n = t(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count_distinct(F.col("ts").cast("date")).alias("nights"))
    return n.withColumn("fires", F.col("nights") >= 3)


@query("""SELECT user_id, bool_and(n >= p) AND count(*) >= 3 AS growing FROM (SELECT user_id, n, coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY wk), 0) AS p FROM (SELECT user_id, date_trunc('week', ts) AS wk, count(*) AS n FROM events GROUP BY ALL)) GROUP BY user_id""")
def monotone_growth(spark, d):
    n = t(spark, d, "events").groupBy("user_id", F.date_trunc("week", "ts").alias("wk")).agg(F.count("*").alias("n"))
    n = n.withColumn("p", F.coalesce(F.lag("n").over(W.partitionBy("user_id").orderBy("wk")), F.lit(0)))
    return n.groupBy("user_id").agg((F.bool_and(F.col("n") >= F.col("p")) & (F.count("*") >= 3)).alias("growing"))


@query(f"""SELECT doc_id, len(list_filter(list_distinct({_W.format("split_part(text, chr(10), 1)")}), lambda x: NOT list_contains({_W.format("substr(text, length(split_part(text, chr(10), 1)) + 1)")}, x))) AS unsupported FROM documents""")
def label_words_grounded(spark, d):
    return t(spark, d, "documents").select("doc_id", words(F.substring_index("text", "\n", 1)).alias("a"), words(F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)")).alias("b")).select("doc_id", F.size(F.array_except("a", "b")).cast("long").alias("unsupported"))


@query("""SELECT item_id, array_to_string(list_filter(string_split(text, '. '), lambda s: NOT contains(lower(s), 'the ')), '. ') AS kept FROM benchmark""")
def sentences_without_token(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.array_join(F.filter(F.split("text", r"\. "), lambda s: ~F.lower(s).contains("the ")), ". ").alias("kept"))


@query(f"""WITH b AS (SELECT item_id, list_distinct({_W.format("text")}) AS w FROM benchmark) SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)), 4) AS overlap FROM b x JOIN b y ON x.item_id < y.item_id AND len(x.w) > 0 AND len(y.w) > 0 AND len(list_intersect(x.w, y.w)) >= 0.2 * least(len(x.w), len(y.w))""")
def title_token_overlap(spark, d):
    b = t(spark, d, "benchmark").select("item_id", F.array_distinct(words("text")).alias("w")).where("size(w) > 0")
    tokens = b.select(F.col("item_id").alias("a"), F.explode("w").alias("x"))
    shared = tokens.join(tokens.withColumnRenamed("a", "b"), "x").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    size = b.select("item_id", F.size("w").alias("k"))
    both = shared.join(size.withColumnsRenamed({"item_id": "a", "k": "ka"}), "a").join(size.withColumnsRenamed({"item_id": "b", "k": "kb"}), "b").withColumn("m", F.least("ka", "kb"))
    return both.where("n >= 0.2 * m").select("a", "b", F.round(F.col("n") / F.col("m"), 4).alias("overlap"))


@query("""WITH RECURSIVE s AS (SELECT o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders), c AS (SELECT k, k AS head, 1 AS len FROM s WHERE k NOT IN (SELECT nxt FROM s WHERE nxt IS NOT NULL) UNION ALL SELECT s.nxt, c.head, c.len + 1 FROM c JOIN s ON s.k = c.k WHERE s.nxt IS NOT NULL) SELECT head, max(len)::BIGINT AS length FROM c GROUP BY head""")
def chain_lengths(spark, d):
    o = t(spark, d, "orders")
    head = first_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("head"))
    return head.join(o.groupBy("o_custkey").agg(F.count("*").alias("length")), "o_custkey").select("head", "length")


@query("""SELECT doc_id, coalesce(regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS iso, len(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\\.[a-z]{2,}')) AS emails FROM documents""")
def extracted_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", F.regexp_extract("text", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("iso"), F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"), F.lit(0))).cast("long").alias("emails"))
