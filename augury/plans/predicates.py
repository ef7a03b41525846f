"""Predicates: tiers and kinds, arrays, prefixes, hierarchies, routes of search texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions import codes as C
from augury.functions.references import OFFICES

from .catalog import query, t

_NAMES = ("OpenAlex Works", "bioRxiv Preprints", "NSF Awards", "NIH RePORTER", "Hacker News", "SEC Form D", "Funding call EU", "arXiv Preprints")
_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_SOURCES = f"""(SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'research' WHEN 1 THEN 'brand' ELSE 'api' END AS kind, {_LIST}[(o_orderkey % 8)::INT + 1] AS name, CASE WHEN o_orderkey % 11 = 0 THEN 'EP' || o_orderkey END AS pub,
CASE o_orderkey % 6 WHEN 0 THEN 'article' WHEN 1 THEN 'review' WHEN 2 THEN 'book-chapter' WHEN 3 THEN 'dataset' END AS type, CASE WHEN o_orderkey % 9 = 0 THEN 'https://GitHub.com/x/' || o_orderkey WHEN o_orderkey % 9 = 1 THEN 'https://doi.org/10.5281/' || o_orderkey ELSE 'https://a.example/' || o_orderkey END AS url FROM orders)"""


def sources(spark, d):
    """Orders as rows of sources: kind, name, publication number, work type, address."""
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "research").when(k % 5 == 1, "brand").otherwise("api")
    type_ = F.when(k % 6 == 0, "article").when(k % 6 == 1, "review").when(k % 6 == 2, "book-chapter").when(k % 6 == 3, "dataset")
    url = F.when(k % 9 == 0, F.concat(F.lit("https://GitHub.com/x/"), k)).when(k % 9 == 1, F.concat(F.lit("https://doi.org/10.5281/"), k)).otherwise(F.concat(F.lit("https://a.example/"), k))
    return t(spark, d, "orders").select(k.alias("id"), kind.alias("kind"), F.element_at(F.array(*map(F.lit, _NAMES)), (k % 8 + 1).cast("int")).alias("name"), F.when(k % 11 == 0, F.concat(F.lit("EP"), k)).alias("pub"), type_.alias("type"), url.alias("url"))


_PRE = "(lower(name) LIKE '%arxiv%' OR lower(name) LIKE '%biorxiv%' OR lower(name) LIKE '%medrxiv%' OR lower(name) LIKE '%preprint%')"
_FUND = "(lower(name) LIKE '%nsf%' OR lower(name) LIKE '%nih%' OR lower(name) LIKE '%reporter%' OR lower(name) LIKE '%openaire%' OR lower(name) LIKE '%ukri%' OR lower(name) LIKE '%gateway to research%' OR lower(name) LIKE '%funding call%'{})"
_TIER = "CASE WHEN pub <> '' THEN 'patent' WHEN kind = 'research' THEN 'science' WHEN kind = 'api' AND {} THEN 'science' WHEN kind = 'api' AND {} THEN 'funding' ELSE 'market' END"


@query(f"""SELECT id, {_TIER.format(_PRE, _FUND.format(" OR lower(name) LIKE '%form d%'"))} AS discovery, {_TIER.format(_PRE, _FUND.format(''))} AS lead,
CASE WHEN pub IS NOT NULL THEN 'patent' WHEN kind = 'research' OR name ILIKE '%openalex%' OR name ILIKE '%rxiv%' THEN 'science' WHEN name ILIKE '%nsf%' OR name ILIKE '%nih%' OR name ILIKE '%openaire%' OR name ILIKE '%ukri%' OR name ILIKE '%form d%' THEN 'funding' ELSE 'market' END AS classes,
CASE WHEN pub IS NOT NULL THEN 'patent' WHEN kind = 'research' THEN 'science' WHEN kind = 'api' AND (name LIKE '%NSF%' OR name LIKE '%NIH%' OR name LIKE '%OpenAIRE%' OR name LIKE '%UKRI%' OR name LIKE '%RePORTER%' OR name LIKE '%Gateway to Research%' OR name LIKE 'Funding call%') THEN 'funding'
WHEN kind = 'api' AND (name LIKE '%arXiv%' OR name LIKE '%rxiv%' OR name LIKE '%Preprint%') THEN 'science' ELSE 'market' END AS methods FROM {_SOURCES}""")
def tier_variants(spark, d):
    """The four ways of naming a tier, side by side: they disagree, and each has its readers."""
    three = ("kind", "name", "pub")
    return sources(spark, d).select("id", C.tier(*three).alias("discovery"), C.tier_without_form_d(*three).alias("lead"), C.tier_of_classes(*three).alias("classes"), C.tier_of_methods(*three).alias("methods"))


_KIND = f"""(SELECT *, CASE WHEN regexp_matches(url, '(zenodo\\.org|10\\.5281/|figshare|dryad|osf\\.io|github\\.com|gitlab\\.com|softwareheritage|dataverse|10\\.7910/DVN)', 'i') THEN 'artifact' WHEN type = 'book-chapter' THEN 'chapter' WHEN type IN ('article', 'preprint', 'review') THEN type
WHEN type IS NOT NULL THEN 'artifact' WHEN name IN ('arXiv Preprints', 'biorxiv Preprints', 'medrxiv Preprints') THEN 'preprint' ELSE 'unknown' END AS k FROM {_SOURCES})"""


@query(f"""SELECT id, k AS work_kind FROM {_KIND}""")
def work_kinds(spark, d):
    return sources(spark, d).select("id", C.work_kind("type", "url", "name").alias("work_kind"))


@query(f"""SELECT CASE WHEN name IN ('arXiv Preprints', 'biorxiv Preprints', 'medrxiv Preprints') THEN 'preprints' WHEN name LIKE 'OpenAlex%' THEN 'openalex' ELSE 'journals' END AS grp, count(*) AS papers FROM {_KIND} WHERE coalesce(k, 'unknown') <> 'artifact' GROUP BY 1""")
def papers_by_source_group(spark, d):
    rows = sources(spark, d).where(C.work_kind("type", "url", "name") != "artifact")
    return rows.groupBy(C.source_group("name").alias("grp")).agg(F.count("*").alias("papers"))


@query("""SELECT user_id, list_has_any(ts, ['error', 'purchase']) AS overlaps, list_has_all(ts, ['error', 'purchase']) AS has_all FROM (SELECT user_id, list(DISTINCT event_type) AS ts FROM events WHERE value > 90 GROUP BY user_id)""")
def array_overlap_containment(spark, d):
    e, wanted = t(spark, d, "events").where("value > 90").groupBy("user_id").agg(F.collect_set("event_type").alias("ts")), F.array(F.lit("error"), F.lit("purchase"))
    return e.select("user_id", F.arrays_overlap("ts", wanted).alias("overlaps"), (F.size(F.array_except(wanted, "ts")) == 0).alias("has_all"))


@query("""SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING bool_or(p_name ILIKE '%GAD%' OR p_name ILIKE 'cold%') AND max(p_size) > 10""")
def having_like_any(spark, d):
    hit = F.lower("p_name").contains("gad") | F.lower("p_name").startswith("cold")
    return t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.bool_or(hit).alias("hit"), F.max("p_size").alias("top")).where("hit AND top > 10").select("p_brand", "n")


_CODED = """(SELECT p_partkey, chr((65 + p_partkey % 8)::INT) || lpad((p_partkey % 30)::VARCHAR, 2, '0') || chr((65 + p_partkey % 20)::INT) || (1 + p_partkey % 90) || '/' || (p_partkey % 100) AS code, p_retailprice FROM part)"""


def coded(spark, d):
    """Parts with a class code such as H01M10/52."""
    k = F.col("p_partkey")
    code = F.concat(F.expr("char(65 + p_partkey % 8)"), F.lpad((k % 30).cast("string"), 2, "0"), F.expr("char(65 + p_partkey % 20)"), (1 + k % 90).cast("string"), F.lit("/"), (k % 100).cast("string"))
    return t(spark, d, "part").select("p_partkey", code.alias("code"), "p_retailprice")


def code_prefixes(given: list[str]) -> list[str]:
    """The valid ones among given code prefixes, upper case, without blanks; others raise."""
    import re

    out = [g.replace(" ", "").upper() for g in given]
    if bad := [g for g in out if not re.fullmatch(r"[A-HY](\d{2}([A-Z](\d{1,4}(/\d{0,6})?)?)?)?", g)]:
        raise ValueError(f"no class codes: {bad}")
    return out


@query(f"""SELECT substr(code, 1, 4) AS subclass, count(*) AS n FROM {_CODED} WHERE code LIKE 'B%' OR code LIKE 'C02%' OR code LIKE 'D03D1%' GROUP BY 1""")
def code_prefix_counts(spark, d):
    wanted = code_prefixes(["b", "C02", "D03D 1"])
    return coded(spark, d).where(" OR ".join(f"code LIKE '{p}%'" for p in wanted)).groupBy(F.substring("code", 1, 4).alias("subclass")).agg(F.count("*").alias("n"))


@query("""WITH a(said) AS (VALUES ('asia'), ('NATION_3'), ('AFRIC'), ('nation_99')), n AS (SELECT lower(n_name) AS name, n_nationkey AS k FROM nation UNION ALL SELECT lower(r_name), n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey), u AS (SELECT DISTINCT name FROM n)
SELECT said, list_aggregate((SELECT list(k ORDER BY k) FROM n WHERE name = lower(said)), 'string_agg', ',') AS keys, CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE name = lower(said)) THEN (SELECT arg_min(name, (levenshtein(name, lower(said)), name)) FROM u) END AS meant FROM a""")
def topic_scope(spark, d):
    """Names of two levels of a hierarchy to the keys below them; an unknown name gets the nearest known one."""
    n, r = t(spark, d, "nation"), t(spark, d, "region")  # 25 and 5 rows
    names = n.select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("k")).unionByName(n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("name"), F.col("n_nationkey").alias("k")))
    names = names.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("keys"))
    asked = spark.createDataFrame([("asia",), ("NATION_3",), ("AFRIC",), ("nation_99",)], "said string")
    near = asked.crossJoin(F.broadcast(names.select("name"))).groupBy("said").agg(F.min_by("name", F.struct(F.levenshtein(F.lower("said"), "name").alias("e"), "name")).alias("near"))
    found = asked.join(names, F.lower("said") == F.col("name"), "left").join(near, "said")
    return found.select("said", "keys", F.when(F.col("keys").isNull(), F.col("near")).alias("meant"))


@query(r"""WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]{7,}', 0)) AS n FROM documents), y AS (SELECT *, coalesce(try_cast(left(n, 4) AS INT) BETWEEN 1900 AND 2100, false) AS year FROM n)
SELECT doc_id, n AS number, CASE WHEN year AND length(n) = 11 AND substr(n, 5, 1) = '0' THEN n || ' ' || left(n, 4) || substr(n, 6) WHEN year AND length(n) = 10 THEN n || ' ' || left(n, 4) || '0' || substr(n, 5) ELSE n END AS variants FROM y""")
def publication_number_variants(spark, d):
    """The spellings of every long number in a text: with and without a zero before the serial behind a year."""
    n = t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{7,}"), F.lit(0)))).alias("number"))
    return n.select("doc_id", "number", F.array_join(C.number_variants("number"), " ").alias("variants"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE NOT (month(o_orderdate) = 1 AND day(o_orderdate) = 1 AND o_orderpriority LIKE '1-%') GROUP BY 1""")
def day_precision_only(spark, d):
    """Dates of 1 January count only where their source gives days."""
    year_only = (F.month("o_orderdate") == 1) & (F.dayofmonth("o_orderdate") == 1) & F.col("o_orderpriority").startswith("1-")
    return t(spark, d, "orders").where(~year_only).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT id >= 2147483648 AS archived, count(*) AS n, min(id % 2147483648)::BIGINT AS low FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT o_orderkey + 2147483648 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def id_spaces(spark, d):
    o = t(spark, d, "orders")
    ids = o.select(F.col("o_orderkey").alias("id")).unionByName(o.where("o_orderstatus = 'F'").select((F.col("o_orderkey") + F.lit(1 << 31)).alias("id")))
    return ids.groupBy((F.col("id") >= F.lit(1 << 31)).alias("archived")).agg(F.count("*").alias("n"), F.min(F.col("id") % F.lit(1 << 31)).alias("low"))


@query(r"""WITH n AS (SELECT doc_id, trim(split_part(text, '. ', 1)) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN length(n) BETWEEN 3 AND 59 AND NOT regexp_matches(n, '["''’]') AND NOT (upper(n) = n AND lower(n) <> n AND contains(n, ' ')) THEN n END AS actor FROM n""")
def actor_names(spark, d):
    """The first sentence of every text where it can be a name: short, without quotes, no line of capitals."""
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", C.actor_name(F.split_part("text", F.lit(". "), F.lit(1))).alias("actor"))


def in_scope(scope: dict) -> "F.Column":
    """A condition from a scope's parts, any of them left out: statuses, customers from..to, after, at_least."""
    parts = {"statuses": lambda v: F.col("o_orderstatus").isin(*v), "customers": lambda v: F.col("o_custkey").between(*v), "after": lambda v: F.col("o_orderdate") >= F.lit(v).cast("timestamp_ntz"), "at_least": lambda v: F.col("o_totalprice") >= v}
    out = F.lit(True)
    for k, v in scope.items():
        out = out & parts[k](v)
    return out


@query("""SELECT 'open' AS scope, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 100000 UNION ALL SELECT 'late', count(*) FROM orders WHERE o_orderdate >= '1997-06-01' AND o_custkey BETWEEN 10 AND 90 UNION ALL SELECT 'all', count(*) FROM orders""")
def scope_filters(spark, d):
    scopes = {"open": {"statuses": ["O", "P"], "at_least": 100000}, "late": {"after": "1997-06-01", "customers": (10, 90)}, "all": {}}
    o = t(spark, d, "orders")
    n = o.agg(*(F.count_if(in_scope(s)).alias(k) for k, s in scopes.items()))
    return n.unpivot([], list(scopes), "scope", "n")


def search_route(q):
    """number, doi, class, years, web (words with operators, or one word) or phrase."""
    route = F.when(q.rlike(rf"^({'|'.join(OFFICES)})[ -]?[0-9]{{6,}}"), "number").when(q.rlike(r"^10\.[0-9]{4,9}/"), "doi").when(q.rlike(r"^[A-HY][0-9]{2}[A-Z]([0-9]{1,4}(/[0-9]{1,6})?)?$"), "class")
    return route.when(q.rlike(r"^(19|20)[0-9]{2} ?[-–] ?(19|20)[0-9]{2}$"), "years").when(q.contains('"') | q.contains(" OR ") | ~q.contains(" "), "web").otherwise("phrase")


@query(r"""SELECT q, CASE WHEN regexp_matches(q, '^(EP|US|WO|CN|JP|KR|DE|GB|FR)[ -]?[0-9]{6,}') THEN 'number' WHEN regexp_matches(q, '^10\.[0-9]{4,9}/') THEN 'doi' WHEN regexp_matches(q, '^[A-HY][0-9]{2}[A-Z]([0-9]{1,4}(/[0-9]{1,6})?)?$') THEN 'class'
WHEN regexp_matches(q, '^(19|20)[0-9]{2} ?[-–] ?(19|20)[0-9]{2}$') THEN 'years' WHEN q LIKE '%"%' OR q LIKE '% OR %' OR q NOT LIKE '% %' THEN 'web' ELSE 'phrase' END AS route
FROM (SELECT p_name AS q FROM part UNION SELECT p_brand FROM part UNION SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT trim(split_part(text, '. ', 1)) FROM documents WHERE text IS NOT NULL UNION SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9/.-]*[0-9][A-Za-z0-9/.-]*', 0)) FROM documents)""")
def search_routes(spark, d):
    """Which way a search text goes: a number, a reference, a class, years, a phrase or words. Asked with names, addresses, first sentences and all that holds a figure
    in the texts."""
    docs = t(spark, d, "documents").where("text IS NOT NULL")
    part = t(spark, d, "part")
    q = part.select(F.col("p_name").alias("q")).union(part.select("p_brand")).union(t(spark, d, "pages").where("url IS NOT NULL").select("url")).union(docs.select(F.trim(F.split_part("text", F.lit(". "), F.lit(1)))))
    q = q.union(docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9/.-]*[0-9][A-Za-z0-9/.-]*"), F.lit(0))))).distinct()
    return q.select("q", search_route(F.col("q")).alias("route"))
