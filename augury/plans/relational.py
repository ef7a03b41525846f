"""Relational queries: projections, filters, groupings, ranked and capped views, set operations, change plans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.dates import month_key
from augury.functions.scores import ratio
from augury.operators import relational as R

from .catalog import query, t


@query("""SELECT month, region, n, round(n / sum(n) OVER (PARTITION BY month), 6)::DOUBLE AS share FROM (
SELECT strftime(o_orderdate, '%Y-%m') AS month, r_name AS region, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)""")
def tier_share_by_month(spark, d):
    places = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # two fixed tables of 25 and 5 rows
    rows = (t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")))
    n = rows.groupBy(month_key("o_orderdate").alias("month"), F.col("r_name").alias("region")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("month")), 6))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(spark, d):
    return R.first_per_key(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5""")
def per_source_cap(spark, d):
    return R.first_per_key(t(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5)


@query("""SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE lang = 'en' GROUP BY ALL""")
def facet_counts_minus_self(spark, d):
    return R.facet_counts(t(spark, d, "documents").select("lang", "source"), {"lang": F.col("lang") == "en", "source": F.col("source").isin("src1", "src2", "src3")})


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderdate > m - INTERVAL 30 DAY) AS n30, count(*) FILTER (WHERE o_orderdate > m - INTERVAL 90 DAY) AS n90,
count(*) FILTER (WHERE o_orderdate > m - INTERVAL 365 DAY) AS n365, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses
FROM orders, (SELECT max(o_orderdate) AS m FROM orders) GROUP BY o_orderpriority""")
def conditional_window_counts(spark, d):
    o = t(spark, d, "orders")
    o = o.crossJoin(o.agg(F.max("o_orderdate").alias("m")))  # one row
    counts = [F.count_if(F.col("o_orderdate") > F.col("m") - F.expr(f"INTERVAL {n} DAY")).alias(f"n{n}") for n in (30, 90, 365)]
    return o.groupBy("o_orderpriority").agg(*counts, F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@query("""SELECT count(*) AS n_users FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 4)""")
def having_distinct(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("k")).where("k >= 4").agg(F.count("*").alias("n_users"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5) FILTER (WHERE value >= 10), 6) AS median_high, count(*) AS n FROM events GROUP BY event_type HAVING count(*) >= 3""")
def filtered_median_by_job(spark, d):
    e = t(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile(F.when(F.col("value") >= 10, F.col("value")), 0.5), 6).alias("median_high"), F.count("*").alias("n"))
    return e.where("n >= 3")


@query("""SELECT l_returnflag, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY ALL""")
def percentile_array(spark, d):
    p = t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", [0.1, 0.5, 0.9]).alias("p"))
    return p.select("l_returnflag", *(F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id""")
def string_agg_distinct(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("""SELECT l_orderkey, string_agg(l_partkey::VARCHAR, '>' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey""")
def ordered_array_agg(spark, d):
    xs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(xs, lambda x: x["l_partkey"].cast("string")), ">").alias("parts"))


@query("""SELECT l_orderkey, arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY l_orderkey""")
def argmin_first(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("first_part"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def semi_exists(spark, d):
    big = t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""")
def anti_not_exists(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT s_suppkey FROM supplier WHERE s_nationkey IS NULL OR s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900 AND c_nationkey IS NOT NULL)""")
def not_in_null_guard(spark, d):
    bad = t(spark, d, "customer").where("c_acctbal < -900 AND c_nationkey IS NOT NULL").select(F.col("c_nationkey").alias("s_nationkey"))
    return t(spark, d, "supplier").join(bad, "s_nationkey", "left_anti").select("s_suppkey")  # a null key matches nothing and stays


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (200000.0, 500) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20""")
def row_value_keyset(spark, d):
    o = t(spark, d, "orders").where(F.expr("struct(o_totalprice, o_orderkey) < struct(200000.0D, 500L)"))
    return o.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_totalprice")


@query("""SELECT least(count(*), 500) AS n, count(*) > 500 AS clamped FROM orders WHERE o_orderstatus = 'F'""")
def clamped_count(spark, d):
    return R.clamped_count(t(spark, d, "orders").where("o_orderstatus = 'F'"), 500)


@query("""SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_topic_hierarchy(spark, d):
    places = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, year(l_shipdate)::INT AS y, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, year(l_shipdate))""")
def cube_office_year(spark, d):
    return t(spark, d, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("y")).cube("l_returnflag", "y").agg(F.count("*").alias("n"))


@query("""SELECT y, count(*) AS families, sum(late)::BIGINT AS late FROM (SELECT l_orderkey, min(year(l_shipdate))::INT AS y, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS late FROM lineitem GROUP BY l_orderkey) GROUP BY y""")
def two_level_agg(spark, d):
    one = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.year(F.min("l_shipdate")).alias("y"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("late"))
    return one.groupBy("y").agg(F.count("*").alias("families"), F.sum("late").alias("late"))


@query("""SELECT l_shipdate::DATE AS day, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END), 0), 6) AS r FROM lineitem GROUP BY ALL""")
def ratio_nullif(spark, d):
    q = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))
    return t(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.round(ratio(q("R"), q("A")), 6).alias("r"))


@query("""SELECT 'customer' AS kind, c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL""")
def union_all_tagged(spark, d):
    count = lambda name, c, kind: t(spark, d, name).groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "k", "n")
    return count("customer", "c_nationkey", "customer").unionByName(count("supplier", "s_nationkey", "supplier"))


@query("""SELECT DISTINCT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer""")
def intersect_operator_sets(spark, d):
    return t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(t(spark, d, "customer").select("c_nationkey"))


@query("""SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def except_new_keys(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(t(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("""SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10""")
def top_n_groups(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("""SELECT n_name, p_brand, year(l_shipdate)::INT AS y, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def star_join_four(spark, d):
    j = (t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
         .join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")))
    return j.groupBy("n_name", "p_brand", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, coalesce(quality::VARCHAR, 'unknown') AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def left_join_default(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality"))


@query("""SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders""")
def correlated_family_size(spark, d):
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return t(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))


@query("""SELECT c_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def lateral_first_by_seq(spark, d):
    first = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
    return t(spark, d, "customer").select("c_custkey").join(first, "c_custkey", "left")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM events QUALIFY dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) <= 3) GROUP BY user_id""")
def lateral_array_limit(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 3), ",").alias("types"))


@query("""SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1 AND l_returnflag = 'R')""")
def disjunctive_semi(spark, d):
    ids = t(spark, d, "lineitem").where("l_quantity = 50 OR (l_discount >= 0.1 AND l_returnflag = 'R')").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, d, "part").select("p_partkey").join(ids, "p_partkey", "left_semi")


@query("""SELECT size, count(*) AS groups_n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM (SELECT count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY size""")
def group_size_histogram(spark, d):
    h = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups_n"))
    total = h.agg(F.sum("groups_n").alias("total"))  # one row
    return h.crossJoin(total).select("size", "groups_n", F.round(F.col("groups_n") / F.col("total"), 6).alias("share"))


@query("""SELECT l_suppkey, round(sum(l_quantity * (1 - l_discount)), 4) AS weight FROM lineitem GROUP BY l_suppkey""")
def weighted_sum(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))), 4).alias("weight"))


@query("""SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_linestatus = 'F') AS all_final FROM lineitem GROUP BY l_orderkey""")
def bool_or_flags(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_linestatus") == "F").alias("all_final"))


@query("""SELECT source, lang FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""")
def mode_per_group(spark, d):
    n = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"))


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS total FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25""")
def page_with_total(spark, d):
    hits = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    page = hits.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(25).limit(25).select("o_orderkey", "o_totalprice")
    return page.crossJoin(hits.agg(F.count("*").alias("total")))  # one row


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer WHERE c_custkey % 2 = 0) a
FULL JOIN (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0) b ON a.k = b.k""")
def upsert_coalesce(spark, d):
    c = t(spark, d, "customer")
    held = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return R.upsert(held, c.where("c_custkey % 2 = 1 OR c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), "k", ["v"])


@query("""SELECT source, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT source, min(doc_id) FROM documents WHERE lang = 'de' AND source NOT IN (SELECT source FROM documents WHERE lang = 'en') GROUP BY source""")
def insert_ignore(spark, d):
    docs = t(spark, d, "documents").select("source", "doc_id", "lang")
    return R.insert_new(docs.where("lang = 'en'").drop("lang"), docs.where("lang = 'de'").drop("lang"), "source", [F.col("doc_id")])


@query("""SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_extendedprice DESC, l_orderkey, l_linenumber""")
def distinct_on(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return R.first_per_key(rows, ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_extendedprice")


@query("""SELECT coalesce(h.k, n.k) AS k, CASE WHEN h.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'retract' WHEN h.v IS DISTINCT FROM n.v THEN 'update' ELSE 'unchanged' END AS action
FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 4 <> 0) h FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 4 = 0) n ON h.k = n.k""")
def cdc_plan(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return R.change_plan(o.where("k % 4 <> 0"), o.where("k % 5 <> 0 OR k % 4 = 0").withColumn("v", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("v"))), "k", "v")


@query("""SELECT l_partkey, base, recent, round(recent / base, 6) AS growth FROM (SELECT l_partkey, count(*) FILTER (WHERE year(l_shipdate) = lo) AS base, count(*) FILTER (WHERE year(l_shipdate) = hi - 1) AS recent
FROM lineitem, (SELECT min(year(l_shipdate)) AS lo, max(year(l_shipdate)) AS hi FROM lineitem) GROUP BY l_partkey) WHERE base >= 3 ORDER BY growth DESC, l_partkey LIMIT 10""")
def growth_with_base_floor(spark, d):
    li = t(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"))
    li = li.crossJoin(li.agg(F.min("y").alias("lo"), F.max("y").alias("hi")))  # one row
    g = li.groupBy("l_partkey").agg(F.count_if(F.col("y") == F.col("lo")).alias("base"), F.count_if(F.col("y") == F.col("hi") - 1).alias("recent")).where("base >= 3")
    return g.withColumn("growth", F.round(F.col("recent") / F.col("base"), 6)).orderBy(F.desc("growth"), "l_partkey").limit(10)


@query("""WITH e AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS bought, avg(value) AS mean FROM events GROUP BY user_id)
SELECT user_id, round(0.5 * least(1, n / 200) + 0.3 * bought / n + 0.2 * (1 - errors / n), 6)::DOUBLE AS score, CASE WHEN errors > bought THEN 'review' WHEN n < 20 THEN 'watch' ELSE 'keep' END AS action FROM e""")
def weighted_source_report(spark, d):
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    e = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), of("error").alias("errors"), of("purchase").alias("bought"))
    score = 0.5 * F.least(F.lit(1.0), F.col("n") / 200) + 0.3 * F.col("bought") / F.col("n") + 0.2 * (1 - F.col("errors") / F.col("n"))
    return e.select("user_id", F.round(score, 6).alias("score"), F.when(F.col("errors") > F.col("bought"), "review").when(F.col("n") < 20, "watch").otherwise("keep").alias("action"))


@query("""SELECT year(o_orderdate)::INT AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, round(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0), 6) AS r FROM orders GROUP BY ALL""")
def pivot_event_ratio(spark, d):
    p = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)
    return p.select("y", F.col("F").alias("f"), F.col("O").alias("o"), F.round(ratio("F", "O"), 6).alias("r"))


@query("""SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'science' WHEN source LIKE 'src1%' THEN 'patent' WHEN lang = 'de' THEN 'funding' ELSE 'market' END AS tier FROM documents""")
def tier_case(spark, d):
    tier = F.when(F.col("source").isin("src0", "src1"), "science").when(F.col("source").startswith("src1"), "patent").when(F.col("lang") == "de", "funding").otherwise("market")
    return t(spark, d, "documents").select("doc_id", tier.alias("tier"))


@query("""SELECT doc_id FROM documents WHERE (lang IN ('en', 'fr')) AND coalesce(source, '') NOT IN ('src3') AND n_chars BETWEEN 200 AND 4000 AND regexp_matches(text, '(?i)licen[cs]ed') """)
def composite_filter(spark, d):
    return t(spark, d, "documents").where(F.col("lang").isin("en", "fr") & ~F.coalesce("source", F.lit("")).isin("src3") & F.col("n_chars").between(200, 4000) & F.col("text").rlike("(?i)licen[cs]ed")).select("doc_id")


@query("""SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value > 50) AS high FROM events""")
def many_aggregates(spark, d):
    return t(spark, d, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 50).alias("high"))
