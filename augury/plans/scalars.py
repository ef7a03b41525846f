"""Scalar functions applied to whole tables: keys, calendar, JSON, hashes, scores, text quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions import dates as D
from augury.functions import scores as C
from augury.functions import text as T
from augury.operators.quality import garbage_reasons as reasons
from augury.operators.resolve import rows_of_pairs

from .catalog import query, t

_FOLD = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_FORMS = T.LEGAL_FORMS


@query(f"""SELECT c_custkey, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({_FOLD.format("c_name || ' Söhne GmbH & Co. KG'")}, '&', ' and ', 'g'), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), ' +', ' ', 'g')), '( and)?( ({_FORMS}))+$', ''), '( ({_FORMS}))+$', '') AS key FROM customer""")
def norm_company_key(spark, d):
    return t(spark, d, "customer").select("c_custkey", T.company_key(F.concat("c_name", F.lit(" Söhne GmbH & Co. KG"))).alias("key"))


@query("""WITH p AS (SELECT p_partkey, p_brand, list_distinct([('  ' || lower(p_name) || ' ')[i:i + 2] for i in range(1, length(p_name) + 2)]) AS g FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS sim FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.5""")
def trigram_jaccard(spark, d):
    """Similarities of distinct names, found by the trigrams they share; parts meet by their names afterwards."""
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    grams = p.select("p_name").distinct().select("p_name", T.trigrams("p_name").alias("g")).select("p_name", F.size("g").alias("n"), F.explode("g").alias("g"))
    x, y = (grams.select("g", F.col("p_name").alias(f"p_name_{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    sims = x.join(y, "g").groupBy("p_name_a", "p_name_b", "na", "nb").agg(F.count("*").alias("c"))
    sims = sims.withColumn("sim", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).where("sim >= 0.5").select("p_name_a", "p_name_b", F.round("sim", 6).alias("sim"))
    return rows_of_pairs(sims.withColumnsRenamed({"p_name_a": "na", "p_name_b": "nb"}).select("na", "nb", "sim"), p, "p_partkey", "p_name", ["p_brand"], keep=lambda a, b: a < b).select("a", "b", "sim")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 97)::DOUBLE * 1e6 WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 97)::DOUBLE * 1e3 ELSE NULL END AS amount, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency FROM orders""")
def parse_money(spark, d):
    said = F.when(F.col("o_orderkey") % 3 == 0, F.format_string("raised $%dM in seed", F.col("o_orderkey") % 97)).when(F.col("o_orderkey") % 3 == 1, F.format_string("secures EUR %dk grant", F.col("o_orderkey") % 97)).otherwise("undisclosed")
    return t(spark, d, "orders").select("o_orderkey", T.money(said).alias("amount"), T.currency(said).alias("currency"))


@query("""SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS total, max((props->>'$.k')::INT) AS top FROM events GROUP BY event_type""")
def json_unnest_counts(spark, d):
    e = t(spark, d, "events").select("event_type", F.explode(F.map_values(F.from_json("props", "map<string,int>"))).alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


@query("""SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') AS rebuilt FROM benchmark""")
def inverted_index_rebuild(spark, d):
    words = t(spark, d, "benchmark").select("item_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "w"))
    index = words.groupBy("item_id", "w").agg(F.collect_list("pos").alias("at")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("inv"))
    pairs = F.flatten(F.transform(F.map_entries("inv"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return index.select("item_id", F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ").alias("rebuilt"))


@query("""SELECT o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS m, strftime(o_orderdate, '%Y-%m') AS label, date_trunc('month', o_orderdate)::DATE AS first FROM orders""")
def month_int_roundtrip(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", D.month_int("o_orderdate").alias("m"))
    return o.select("*", D.month_label("m").alias("label"), D.month_start("m").alias("first"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, date_trunc('week', o_orderdate)::DATE AS monday, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate) AS quarter, (date_trunc('quarter', o_orderdate) - INTERVAL 24 MONTH)::DATE AS back FROM orders""")
def iso_week_label(spark, d):
    return t(spark, d, "orders").select("o_orderkey", D.iso_week("o_orderdate").alias("week"), D.week_start("o_orderdate").alias("monday"), D.quarter_key("o_orderdate").alias("quarter"), D.quarter_start_back("o_orderdate", 2).alias("back"))


@query("""SELECT b, count(*) AS n FROM (SELECT ((l_orderkey * 2654435761) % 4294967296) % 16 AS b FROM lineitem) GROUP BY b""")
def knuth_hash_bucket(spark, d):
    return t(spark, d, "lineitem").groupBy(C.knuth_bucket("l_orderkey", 16).alias("b")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, round(100 * (0.3 * CASE p_brand WHEN 'Brand#1' THEN 1.0 WHEN 'Brand#2' THEN 0.7 ELSE 0.4 END + 0.25 * greatest(0, least(1, ln(1 + p_retailprice) / ln(1 + 5000))) + 0.2 * greatest(0, least(1, p_size / 50.0)) + 0.25 * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END), 4)::DOUBLE AS crs FROM part""")
def crs_score(spark, d):
    brand = F.when(F.col("p_brand") == "Brand#1", 1.0).when(F.col("p_brand") == "Brand#2", 0.7).otherwise(0.4)
    score = 0.3 * brand + 0.25 * C.log_scale("p_retailprice", 5000.0) + 0.2 * C.clamp(F.col("p_size") / 50.0, 0.0, 1.0) + 0.25 * F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(0)
    return t(spark, d, "part").select("p_partkey", F.round(100 * score, 4).alias("crs"))


@query("""SELECT source, CASE WHEN count(*) > 1 THEN round(-sum(p * ln(p)) / ln(count(*)), 4) ELSE 0.0 END AS entropy FROM (SELECT source, count(*) / sum(count(*)) OVER (PARTITION BY source) AS p FROM documents GROUP BY source, lang) GROUP BY source""")
def entropy_reach(spark, d):
    from pyspark.sql import Window as W

    n = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("source")))
    return p.groupBy("source").agg(F.when(F.count("*") > 1, F.round(-F.sum(F.col("p") * F.log("p")) / F.log(F.count("*").cast("double")), 4)).otherwise(0.0).alias("entropy"))


@query("""SELECT doc_id, CASE WHEN length(trim(text)) < 40 THEN 'short' WHEN len(list_distinct(w)) < 0.3 * len(w) THEN 'repetitive' WHEN length(regexp_replace(text, '[^!*%$&#|]', '', 'g')) > 0.05 * length(text) THEN 'symbols' WHEN regexp_matches(text, '\\s{6,}') THEN 'whitespace' WHEN text = upper(text) THEN 'shouting' ELSE 'ok' END AS reason
FROM (SELECT doc_id, text, string_split_regex(lower(trim(text)), '\\s+') AS w FROM documents)""")
def garbage_reasons(spark, d):
    return t(spark, d, "documents").select("doc_id", reasons("text").alias("reason"))


@query("""WITH n AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '([0-9][0-9,.]*[0-9]|[0-9])', 1), lambda x: replace(x, ',', ''))) AS xs FROM documents), b AS (SELECT list_distinct(list_transform(regexp_extract_all(string_agg(text, ' '), '([0-9][0-9,.]*[0-9]|[0-9])', 1), lambda x: replace(x, ',', ''))) AS ys FROM benchmark)
SELECT doc_id, len(list_filter(xs, lambda x: NOT list_contains(ys, x))) AS ungrounded FROM n, b WHERE len(xs) > 0""")
def ungrounded_numbers(spark, d):
    x = t(spark, d, "documents").select("doc_id", T.number_tokens("text").alias("xs")).where("size(xs) > 0")
    known = t(spark, d, "benchmark").select(F.explode(T.number_tokens("text")).alias("x")).distinct().withColumn("known", F.lit(1))
    flat = x.select("doc_id", F.explode("xs").alias("x")).join(known, "x", "left")
    return flat.groupBy("doc_id").agg(F.count_if(F.col("known").isNull()).alias("ungrounded"))


@query("""SELECT p_partkey, md5(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) || '|' || trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS fp FROM part""")
def text_fingerprint(spark, d):
    return t(spark, d, "part").select("p_partkey", T.fingerprint("p_name", "p_type").alias("fp"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part""")
def slugs(spark, d):
    return t(spark, d, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("""SELECT c_custkey, least(coalesce(CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-05-01' END, DATE '2024-03-01'), DATE '2024-03-01') AS sort_date, (round((greatest(-1000, least(1000, c_acctbal)) + 1000) / 2000 * 65535))::INT AS q, abs(c_acctbal - c_acctbal * 1.0000001) <= 1e-6 * greatest(1, abs(c_acctbal), abs(c_acctbal * 1.0000001)) AS same FROM customer""")
def row_scalars(spark, d):
    pub = F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-05-01").cast("date"))
    c = t(spark, d, "customer").withColumn("x", F.col("c_acctbal") * 1.0000001)
    return c.select("c_custkey", D.sort_date(pub, F.lit("2024-03-01").cast("date")).alias("sort_date"), C.quantise16("c_acctbal", 1000.0).alias("q"), C.nearly_equal("c_acctbal", "x").alias("same"))


def html_to_text(spark, d):
    return t(spark, d, "pages").select("page_id", T.strip_tags("html").alias("text"))


query()(html_to_text)


@query("""SELECT w, s FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM benchmark), LATERAL (SELECT CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND (w LIKE '%sses' OR w LIKE '%shes' OR w LIKE '%ches' OR w LIKE '%xes') THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS s)""")
def stemmed_tokens(spark, d):
    return t(spark, d, "benchmark").select(F.explode(T.words("text")).alias("w")).distinct().select("w", T.stem(F.col("w")).alias("s"))
