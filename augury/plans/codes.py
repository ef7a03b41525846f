"""Scalars: names, codes, tags, cleaned texts, JSON, references, scaled and fitted numbers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions import abstracts as A
from augury.functions import codes as C
from augury.functions import references as R
from augury.functions import text as T
from augury.functions.scores import ratio

from .catalog import query, t
from .predicates import _CODED, coded

_S = lambda c: c.cast("string")


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^(www|m|amp)[.]', '') AS site, nullif(regexp_extract(url, '^[a-z]+://[^/]*/([a-z]{2})/([0-9]+)', 1), '') AS lang, nullif(regexp_extract(url, '^[a-z]+://[^/]*/([a-z]{2})/([0-9]+)', 2), '') AS number FROM pages WHERE url IS NOT NULL""")
def stripped_prefixes(spark, d):
    """Of every page's address the site without its leading label, and two parts of its path."""
    url, path = F.col("url"), r"^[a-z]+://[^/]*/([a-z]{2})/([0-9]+)"
    site = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)), r"^(www|m|amp)[.]", "")
    part = lambda i: F.nullif(F.regexp_extract(url, path, i), F.lit(""))
    return t(spark, d, "pages").where("url IS NOT NULL").select("page_id", site.alias("site"), part(1).alias("lang"), part(2).alias("number"))


@query("""SELECT n_nationkey, ['CA', 'NY', 'TX', NULL, 'WV'][n_nationkey % 5 + 1] AS state FROM nation""")
def state_codes(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("California", " new york ", "tx", "Bavaria", "West Virginia"))), F.col("n_nationkey") % 5 + 1)
    return t(spark, d, "nation").select("n_nationkey", C.state_code(said).alias("state"))


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct([c.code, 'H01L'])), ',') AS classes, CASE WHEN c.code = 'H01L' THEN 'H01L,H10B,H10D,H10F,H10H,H10K,H10N,H10P,H10W,' ELSE c.code || ',' END || array_to_string(['H01L', 'H10B', 'H10D', 'H10F', 'H10H', 'H10K', 'H10N', 'H10P', 'H10W'], ',') AS widened FROM (SELECT p_partkey, substr(code, 1, 4) AS code FROM {_CODED}) c""")
def class_codes(spark, d):
    """Codes of a text, distinct and sorted; and a pattern list widened by the successors of codes that moved."""
    x = coded(spark, d).withColumn("text", F.concat(F.lit("CPC: "), "code", F.lit("; H01L21/02; "), "code", F.lit(" granted")))
    return x.select("p_partkey", F.array_join(C.subclasses("text"), ",").alias("classes"), F.array_join(C.with_migrated(F.array(F.substring("code", 1, 4), F.lit("H01L"))), ",").alias("widened"))


@query(r"""WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9-]*[0-9]{8,}[A-Za-z0-9-]*', 0)) AS number FROM documents), y AS (SELECT *, try_cast(nullif(regexp_extract(replace(number, '-', ''), '(?:^|[A-Z])((?:19|20)[0-9]{2})[0-9]{7}', 1), '') AS INT) AS y FROM n)
SELECT doc_id, number, CASE WHEN y BETWEEN 1900 AND 2030 THEN y END AS y FROM y""")
def years_of_numbers(spark, d):
    """The year that a number in a text begins with, where it is a plausible one."""
    n = t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9-]*[0-9]{8,}[A-Za-z0-9-]*"), F.lit(0)))).alias("number"))
    found = F.regexp_extract(F.regexp_replace("number", "-", ""), r"(?:^|[A-Z])((?:19|20)[0-9]{2})[0-9]{7}", 1).try_cast("int")
    return n.select("doc_id", "number", F.when(found.between(1900, 2030), found).alias("y"))


_LABELS = "|".join(sorted(A.LABELS, key=len, reverse=True))
_REF = "text"
for _name, _char in A.ENTITIES * 2:
    _REF = f"replace({_REF}, '{_name.replace(chr(39), chr(39) * 2)}', '{_char.replace(chr(39), chr(39) * 2)}')"
_HEAD = "rest"
for _ in range(4):
    _HEAD = rf"""regexp_replace({_HEAD}, '^(?i:{_LABELS})(?: *[:.–—-] *| +([A-Z0-9"''(]))', '\1')"""


@query(rf"""
WITH told AS (SELECT doc_id, trim(regexp_replace(regexp_replace({_REF}, '</?[A-Za-z][^<>]*>', ' ', 'g'), '[\t-\r ]+', ' ', 'g')) AS x FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
parts AS (SELECT *, string_split(replace(replace(x, '. ', '.' || chr(1) || ' '), '©', chr(1) || '©'), chr(1)) AS ps FROM told),
ended AS (SELECT *, array_to_string(ps[1:coalesce(list_max([CASE WHEN regexp_matches(lower(ps[i]), '^ *(©|\(c\) |copyright|this article is protected by copyright|$)|all rights reserved') THEN 0 ELSE i END for i in range(1, len(ps) + 1)]), 0)], '') AS y FROM parts),
tagged AS (SELECT *, CASE WHEN starts_with(y, '[') AND instr(y, ']') BETWEEN 3 AND 82 THEN ltrim(substr(y, instr(y, ']') + 1)) ELSE y END AS rest FROM ended),
cleaned AS (SELECT *, trim(regexp_replace(regexp_replace({_HEAD}, '(^|[^A-Za-z])(?i:{_LABELS}) *:', '\1 ', 'g'), '[\t-\r ]+', ' ', 'g')) AS z FROM tagged)
SELECT doc_id, md5(z) AS cleaned_md5, length(z)::BIGINT AS kept, left('doc ' || doc_id || chr(10) || left(z, 500), 40) AS embedded, ceil(length(z) / 3.4)::BIGINT AS tokens FROM cleaned
""")
def cleaned_texts(spark, d):
    """Every text as an embedder reads it: its digest, length and estimated tokens, and the head of what is embedded, cut
    after cleaning."""
    x = t(spark, d, "documents").select("doc_id", A.clean_text("text").alias("z"))
    return x.select("doc_id", F.md5("z").alias("cleaned_md5"), F.length("z").cast("long").alias("kept"), F.substring(A.embed_text(F.concat(F.lit("doc "), _S(F.col("doc_id"))), F.col("z")), 1, 40).alias("embedded"),
                    F.ceil(F.length("z") / F.lit(3.4).cast("double")).alias("tokens"))


@query("""SELECT o_custkey, sum(n) FILTER (WHERE y >= 1997)::BIGINT AS recent, sum(n)::BIGINT AS total FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""")
def counts_by_year_sums(spark, d):
    """Sums over an array of (year, n), as works carry their citations."""
    by = t(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.collect_list(F.struct("year", "n")).alias("by"))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    recent = F.filter("by", lambda x: x["year"] >= 1997)
    return by.select("o_custkey", F.when(F.size(recent) > 0, add(recent)).alias("recent"), add(F.col("by")).alias("total"))


@query("""SELECT p_partkey, array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) for w in string_split(p_name, ' ')], ' ') || ' · AI Chips' AS label FROM part""")
def tag_labels(spark, d):
    """Tags to one spelling, generic ones and repetitions out, acronyms in capitals, the first two joined."""
    tags = F.array(F.lower(F.translate("p_name", " ", "_")), F.lit("Innovation"), F.regexp_replace("p_name", " ", "-"), F.lit("ai_chips"))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.slice(F.transform(T.thematic_tags(tags), T.tag_label), 1, 2), " · ").alias("label"))


@query("""WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS monday, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT *, (SELECT quantile_cont(v.n, 0.5) FROM w v WHERE v.monday < w.monday AND v.monday >= w.monday - INTERVAL 28 DAY) AS med FROM w)
SELECT strftime(monday, '%G-W%V') AS week, n, round(100 * (n - med) / nullif(med, 0))::DOUBLE AS delta_pct, strftime(monday - INTERVAL 7 DAY, '%G-W%V') AS before FROM m""")
def week_deltas(spark, d):
    """Each week against the median of the (up to) four weeks before it; labels parsed back and moved by a week."""
    w = t(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("monday")).agg(F.count("*").alias("n"))
    w = w.withColumn("i", F.unix_date("monday"))
    before = W.partitionBy(F.lit(0)).orderBy("i").rangeBetween(-28, -1)  # weeks, not rows
    w = w.withColumn("med", F.percentile("n", 0.5).over(before)).withColumn("week", T.iso_label("monday"))
    return w.select("week", "n", F.round(ratio((F.col("n") - F.col("med")) * 100, "med")).alias("delta_pct"), T.iso_label(F.date_sub(T.week_monday("week"), 7)).alias("before"))


@query("""SELECT b AS bucket, count(*) AS n FROM (SELECT instr('0123456789abcdef', left(md5(o_custkey::VARCHAR), 1)) - 1 AS b FROM orders) GROUP BY 1""")
def family_hash_buckets(spark, d):
    """Rows of a family share a bucket: it is taken from a hash of the family's text."""
    return t(spark, d, "orders").groupBy((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(_S(F.col("o_custkey"))), 1, 1)) - 1).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct([lower(p_name), lower(p_brand)])), '|') AS keys FROM part""")
def brand_keys(spark, d):
    """A JSON list to distinct keys: lower case, edges trimmed, at most four words, two characters at least."""
    said = F.to_json(F.array(F.concat(F.lit(" "), F.upper("p_name"), F.lit(".")), F.lit("x"), F.lit("one two three four five"), F.col("p_brand"), F.col("p_name")))
    keys = F.transform(F.from_json(said, "array<string>"), lambda b: F.lower(F.trim(F.regexp_replace(F.regexp_replace(b, r"^[\s\p{P}]+|[\s\p{P}]+$", ""), r"\s+", " "))))
    kept = F.array_distinct(F.filter(keys, lambda b: (F.length(b) >= 2) & (F.size(F.split(b, " ")) <= 4)))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(kept), "|").alias("keys"))


@query("""SELECT event_type AS dev, m AS mount, count(*) AS n, round(sum(value * m), 3) AS used FROM (SELECT event_type, value, unnest(CASE WHEN event_id % 3 = 0 THEN [NULL] ELSE range(1, (event_id % 3)::BIGINT + 1) END) AS m FROM events) GROUP BY ALL""")
def nested_unnest(spark, d):
    """Devices of a JSON sample, and in them their mounts; a device without mounts keeps a row."""
    mounts = F.when(F.col("event_id") % 3 > 0, F.sequence(F.lit(1).cast("long"), F.col("event_id") % 3)).otherwise(F.array().cast("array<bigint>"))
    sample = F.to_json(F.array(F.struct(F.col("event_type").alias("dev"), F.col("value").alias("v"), mounts.alias("mounts"))))
    x = t(spark, d, "events").select(F.inline(F.from_json(sample, "array<struct<dev:string,v:double,mounts:array<bigint>>>"))).select("dev", "v", F.explode_outer("mounts").alias("mount"))
    return x.groupBy("dev", "mount").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * F.col("mount")), 3).alias("used"))


@query("""SELECT event_id, to_json({k: (props->>'$.k')::BIGINT + 1, tags: [event_type, 'new']})::VARCHAR AS props FROM events""")
def json_rewrite(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, d, "events").select("event_id", F.to_json(F.struct((k + 1).alias("k"), F.array("event_type", F.lit("new")).alias("tags"))).alias("props"))


@query("""SELECT o_orderkey, 'Report ' || o_orderkey AS title, o_orderpriority AS concept, split_part(o_orderpriority, '-', 2) AS word, regexp_replace(upper(o_orderpriority), '[^A-Z0-9]', '', 'g') AS key FROM orders""")
def tag_parts(spark, d):
    title = F.concat(F.lit("[Science · "), "o_orderpriority", F.lit("] Report "), _S(F.col("o_orderkey")))
    return t(spark, d, "orders").select("o_orderkey", F.regexp_replace(title, r"^\s*\[[^\]]{1,80}\]\s*", "").alias("title"), F.regexp_extract(title, r"^\[[^·\]]+· ([^\]]+)\]", 1).alias("concept"),
                                        F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("word"), F.regexp_replace(F.upper("o_orderpriority"), "[^A-Z0-9]", "").alias("key"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT m, sum(n) AS t FROM m GROUP BY m HAVING sum(n) >= 5), g AS (SELECT k, t.m, t.t FROM (SELECT DISTINCT k FROM m), t)
SELECT g.k, round(avg(CASE WHEN coalesce(n, 0) / t >= 0.2 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS durability FROM g LEFT JOIN m ON m.k = g.k AND m.m = g.m GROUP BY g.k""")
def active_month_share(spark, d):
    """The part of the dense months in which a group holds a fifth of what is said."""
    n = t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m"), F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    dense = n.groupBy("m").agg(F.sum("n").alias("t")).where("t >= 5")
    months = F.broadcast(dense.agg(F.count("*").alias("months")))  # one row
    active = n.join(dense, "m").groupBy("k").agg(F.count_if(F.col("n") / F.col("t") >= 0.2).alias("active"))
    return active.crossJoin(months).select("k", F.round(F.col("active") / F.col("months"), 6).alias("durability"))


@query("""WITH q AS (SELECT p_brand, median(p_retailprice) AS c, quantile_cont(abs(p_retailprice - (SELECT median(p_retailprice) FROM part)), 0.92) AS s, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand)
SELECT p_partkey, round(ln(1 + p_size), 6) AS age_x, round(greatest(-1, least(1, log2(greatest(1 / 8.0, least(8.0, p_size / 10.0))) / 3)), 6)::DOUBLE AS accel_z, round((p_retailprice - c) / s, 6) AS framed, CASE WHEN hi > lo THEN round((p_size - lo) / (hi - lo), 6) END AS bar FROM part JOIN q USING (p_brand)""")
def scaled_axes(spark, d):
    """Coordinates of a chart: logarithms with clamps, a median centre over the 92nd percentile, bars between extremes."""
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    mid = F.broadcast(p.agg(F.percentile("p_retailprice", 0.5).alias("mid")))  # one row
    q = p.crossJoin(mid).groupBy("p_brand").agg(F.percentile("p_retailprice", 0.5).alias("c"), F.percentile(F.abs(F.col("p_retailprice") - F.col("mid")), 0.92).alias("s"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    clamp = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    return p.join(q, "p_brand").select("p_partkey", F.round(F.log1p("p_size"), 6).alias("age_x"), F.round(clamp(F.log2(clamp(F.col("p_size") / 10, 0.125, 8.0)) / 3, -1.0, 1.0), 6).alias("accel_z"),
                                       F.round((F.col("p_retailprice") - F.col("c")) / F.col("s"), 6).alias("framed"), F.when(F.col("hi") > F.col("lo"), F.round((F.col("p_size") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6)).alias("bar"))


@query("""WITH p AS (SELECT c_nationkey AS g, count(*)::DOUBLE AS x, sum(o_totalprice) / 1e5 AS y FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey), f AS (SELECT g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, avg(y) AS my, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx, count(*) AS n, corr(x, y) AS r FROM p GROUP BY g HAVING count(*) >= 4 AND stddev(x) > 0)
SELECT p.g, round(any_value(r), 6) AS pearson, round(1 - sum(((y - a - b * x) / (1 - 1.0 / n - (x - mx) * (x - mx) / sxx)) ** 2) / sum((y - my) ** 2), 4) AS loo_r2, round(100 * exp(any_value(a) / 10 + any_value(b) / 100) * exp(0.02), 4) AS k FROM p JOIN f ON p.g = f.g GROUP BY p.g""")
def leave_one_out_fit(spark, d):
    """Fits per group: correlation, R2 over residuals that each point has when left out (residual / (1 - leverage)),
    and a rate from the fitted logarithm."""
    p = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", F.col("c_nationkey").alias("g")).agg(F.count("*").cast("double").alias("x"), (F.sum("o_totalprice") / 1e5).alias("y"))
    f = p.groupBy("g").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.regr_sxx("y", "x")).alias("sxx"), F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.stddev("x").alias("sd")).where("n >= 4 AND sd > 0")
    left_out = F.expr("(y - a - b * x) / (1 - 1.0D / n - (x - mx) * (x - mx) / sxx)")
    fit = p.join(f, "g").groupBy("g").agg(F.first("r").alias("r"), F.sum(left_out ** 2).alias("e"), F.sum((F.col("y") - F.col("my")) ** 2).alias("s"), F.first("a").alias("a"), F.first("b").alias("b"))
    return fit.select("g", F.round("r", 6).alias("pearson"), F.round(1 - F.col("e") / F.col("s"), 4).alias("loo_r2"), F.round(F.exp(F.col("a") / 10 + F.col("b") / 100) * 100 * F.exp(F.lit(0.02)), 4).alias("k"))


@query(r"""WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9., ]*[0-9]|[0-9]', 0)) AS said FROM documents)
SELECT doc_id, said, CASE WHEN regexp_matches(said, '^[0-9]{1,3}([ .,][0-9]{3})+$') THEN regexp_replace(said, '[ .,]', '', 'g')::DOUBLE WHEN regexp_matches(said, '^[0-9]+([.,][0-9]+)?$') THEN replace(said, ',', '.')::DOUBLE END AS v FROM n""")
def local_numbers(spark, d):
    """Every figure of every text, read with points, commas or blanks between its thousands, or as a decimal; what is neither is null."""
    n = t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9][0-9., ]*[0-9]|[0-9]"), F.lit(0)))).alias("said"))
    return n.select("doc_id", "said", C.local_number("said").alias("v"))


@query(r"""
WITH said AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
found AS (SELECT doc_id, regexp_extract_all(x, '\b((?:19|20)[0-9]{2})-([0-9]{2})-([0-9]{2})\b', 0) AS days, regexp_extract_all(translate(x, '"''<>)]|,;', '         '), '10\.[0-9]{4,9}/[^ \t\n\v\f\r]+', 0) AS works,
  regexp_extract_all(x, '\b3[0-9]{4}[A-Z]{1,2}[0-9]{4}\b', 0) AS laws, regexp_extract_all(x, '\b(?:EP|US|WO|CN|JP|KR|DE|GB|FR)[ -]?(?:(?:19|20)[0-9]{2}[/-]?[0-9]{5,6}|[0-9]{6,9})(?:[ -]?[ABCUYTE][0-9]?)?\b', 0) AS patents FROM said)
SELECT doc_id, len(list_distinct(list_transform(works, lambda w: rtrim(w, '.'))))::BIGINT AS n_works, len(list_distinct(laws))::BIGINT AS n_laws, len(list_distinct(patents))::BIGINT AS n_patents, array_to_string(list_sort(list_distinct(days)), '|') AS days FROM found
""")
def references_in_text(spark, d):
    """Works, laws, patents and days that every text names."""
    said, day = F.coalesce("text", F.lit("")), "(?=[12])(?<![A-Za-z0-9_])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9_])"
    n = lambda found: F.size(found).cast("long")
    return t(spark, d, "documents").select("doc_id", n(R.works_in(said)).alias("n_works"), n(R.laws_in(said)).alias("n_laws"), n(R.patents_in(said)).alias("n_patents"),
                                           F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(said, F.lit(day), F.lit(0)))), "|").alias("days"))
