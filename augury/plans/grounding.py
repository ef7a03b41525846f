"""Grounding and labels: what a text says that its source doesn't, blocked pages, phrases that set a group apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions import text as T
from augury.functions.lineage import cut
from augury.operators import verify as V
from augury.operators.relational import first_per_key, greedy_picks

from .catalog import query, t


@query(r"""WITH n AS (SELECT DISTINCT conv_id, turn, lower(unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}{2,}', 0))) AS name FROM conversations WHERE role = 'assistant'), k AS (SELECT DISTINCT conv_id, lower(unnest(regexp_extract_all(text, '\p{L}+', 0))) AS w FROM conversations WHERE role <> 'assistant')
SELECT n.conv_id, turn, count(*) AS named, count(*) FILTER (WHERE w IS NULL) AS ungrounded FROM n LEFT JOIN k ON k.conv_id = n.conv_id AND k.w = n.name GROUP BY ALL""")
def ungrounded_names(spark, d):
    """Names in answers, which are words with a capital, and how many of them nobody else in the conversation says."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = lambda rows, pattern, *keys: rows.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("w")).withColumn("w", F.lower("w")).distinct()
    names, known = said(c.where("role = 'assistant'"), r"\p{Lu}\p{Ll}{2,}", "conv_id", "turn"), said(c.where("role <> 'assistant'"), r"\p{L}+", "conv_id")
    both = names.join(known.withColumn("known", F.lit(True)), ["conv_id", "w"], "left")
    return both.groupBy("conv_id", "turn").agg(F.count("*").alias("named"), F.count_if(F.col("known").isNull()).alias("ungrounded"))


@query(r"""SELECT item_id, len(list_filter(string_split(text, '. '), lambda s: contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), trim(regexp_replace(lower(s), '\s+', ' ', 'g')))))::BIGINT AS kept, len(string_split(text, '. '))::BIGINT AS given FROM benchmark""")
def verbatim_items(spark, d):
    """Quoted items that stand in their source word for word, white space and case aside; an invented one goes."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    b = t(spark, d, "benchmark").select("item_id", F.concat(F.split("text", r"\. "), F.array(F.lit("words nobody said here"))).alias("xs"), norm("text").alias("src"))
    return b.select("item_id", F.size(F.filter("xs", lambda x: F.instr("src", norm(x)) > 0)).cast("long").alias("kept"), (F.size("xs") - 1).cast("long").alias("given"))


@query(r"""SELECT doc_id, len(xs)::BIGINT AS n, xs[1] AS first FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]{0,20}[0-9][0-9.,]*[^\n]{0,20}', 0)[1:10] AS xs FROM documents) WHERE len(xs) > 0""")
def figures_with_context(spark, d):
    """Up to ten figures of a text with what stands around them in their line."""
    xs = F.slice(F.regexp_extract_all("text", F.lit(r"[^\n]{0,20}[0-9][0-9.,]*[^\n]{0,20}"), F.lit(0)), 1, 10)
    return t(spark, d, "documents").select("doc_id", xs.alias("xs")).where("size(xs) > 0").select("doc_id", F.size("xs").cast("long").alias("n"), F.element_at("xs", 1).alias("first"))


# What pages say that keep readers out, and the length beyond which a page is an article.
WALLS = (
    "you are a bot", "we apologize for the inconvenience",
    "unusual traffic from your computer network", "has been blocked temporarily",
    "verify you are human", "verify that you are human", "checking your browser",
    "please enable javascript and cookies", "attention required! | cloudflare",
    "pardon our interruption", "request unsuccessful. incapsula",
    "access to this page has been denied",
)
WALL_CHARS = 1500


def is_wall(text):
    """Short texts with a wall's words; a long one is an article that mentions them."""
    low = F.lower(text)
    return (F.length(text) <= WALL_CHARS) & F.exists(F.array(*map(F.lit, WALLS)), lambda w: F.contains(low, w))


_SEEN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\t-\r ]+', ' ', 'g'))"""


@query(f"""SELECT page_id, length(x)::BIGINT AS n_chars, length(x) <= {WALL_CHARS} AND ({" OR ".join(f"contains(lower(x), '{w}')" for w in WALLS)}) AS wall FROM (SELECT page_id, {_SEEN} AS x FROM pages)""")
def bot_walls(spark, d):
    """Pages whose visible text is short and says what walls say."""
    x = t(spark, d, "pages").select("page_id", T.strip_tags(F.coalesce("html", F.lit(""))).alias("x"))
    return x.select("page_id", F.length("x").cast("long").alias("n_chars"), is_wall(F.col("x")).alias("wall"))


@query("""SELECT o_custkey, len(xs)::BIGINT AS given, least(len(xs), 5)::BIGINT AS kept, list_aggregate(list_transform(xs[1:5], lambda x: left(x, 3)), 'string_agg', '|') AS quotes FROM (SELECT o_custkey, list('q' || o_orderkey ORDER BY o_orderkey) AS xs FROM orders GROUP BY 1)""")
def capped_lists(spark, d):
    """The feature is a cap: five items of a list, three characters of an item."""
    x = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    return x.select("o_custkey", F.size("ks").cast("long").alias("given"), F.least(F.size("ks"), F.lit(5)).cast("long").alias("kept"), F.array_join(F.transform(F.slice("ks", 1, 5), lambda k: F.substring(F.concat(F.lit("q"), k.cast("string")), 1, 3)), "|").alias("quotes"))


_GRAMS = "(SELECT p_brand AS nest, p_partkey, unnest(list_distinct([w for w in string_split(lower(p_name), ' ') if w <> ''] || [lower(p_name)])) AS g FROM part)"


@query(f"""WITH m AS (SELECT nest, g, count(*) AS c FROM {_GRAMS} GROUP BY ALL), nn AS (SELECT p_brand AS nest, count(*) AS n FROM part GROUP BY 1), dg AS (SELECT g, count(*) AS c FROM {_GRAMS} GROUP BY g), s AS (SELECT nest, g, m.c / n AS share, (m.c / n) / (dg.c / (SELECT count(*) FROM part)) AS lift FROM m JOIN nn USING (nest) JOIN dg USING (g) WHERE m.c >= 3)
SELECT nest, g AS phrase, round(share * ln(lift) * (CASE WHEN contains(g, ' ') THEN 1.25 ELSE 1 END), 6)::DOUBLE AS score FROM s WHERE lift > 1.2 QUALIFY row_number() OVER (PARTITION BY nest ORDER BY round(share * ln(lift) * (CASE WHEN contains(g, ' ') THEN 1.25 ELSE 1 END), 6) DESC, g) <= 4""")
def lift_phrases(spark, d):
    """Words and phrases by their share in a group times the logarithm of their lift over all; longer ones count more."""
    p = t(spark, d, "part").select(F.col("p_brand").alias("nest"), F.lower("p_name").alias("name"))
    grams = p.select("nest", F.explode(F.array_distinct(F.concat(F.filter(F.split("name", " "), lambda w: w != ""), F.array("name")))).alias("g"))
    m = grams.groupBy("nest", "g").agg(F.count("*").alias("c"))
    whole, nn = m.groupBy("g").agg(F.sum("c").alias("dc")), p.groupBy("nest").agg(F.count("*").alias("n"))
    s = m.where("c >= 3").join(nn, "nest").join(whole, "g").crossJoin(F.broadcast(nn.agg(F.sum("n").alias("dn"))))  # one row
    share = F.col("c") / F.col("n")
    lift = share / (F.col("dc") / F.col("dn"))
    s = s.where(lift > 1.2).withColumn("score", F.round(share * F.log(lift) * F.when(F.contains("g", F.lit(" ")), 1.25).otherwise(1.0), 6))
    return first_per_key(s, ["nest"], [F.desc("score"), F.col("g")], 4).select("nest", F.col("g").alias("phrase"), "score")


@query("""WITH RECURSIVE r AS (SELECT p_type AS grp, p_partkey AS id, p_size AS v, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS i FROM part),
g AS (SELECT grp, 1 AS i, [v] AS taken, [id] AS ids FROM r WHERE i = 1 UNION ALL SELECT g.grp, t.i, CASE WHEN fits THEN list_append(taken, t.v) ELSE taken END, CASE WHEN fits THEN list_append(ids, t.id) ELSE ids END
FROM (SELECT g.*, t.v, t.id, t.i AS ti, len(ids) < 5 AND len(list_filter(taken, lambda x: abs(x - t.v) <= 2)) = 0 AS fits FROM g JOIN r t ON t.grp = g.grp AND t.i = g.i + 1) g JOIN r t ON t.grp = g.grp AND t.i = g.ti)
SELECT grp, list_aggregate(arg_max(ids, i), 'string_agg', ',') AS picked FROM g GROUP BY grp""")
def greedy_distinct_pick(spark, d):
    """By score, skipping what is too like one already taken, until five are or none is left: a round for each pick over all rows of a group."""
    p = t(spark, d, "part").select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("s"), F.col("p_size").alias("v"))
    got = greedy_picks(p, "grp", [-F.col("s"), F.col("id")], ["id", "v"], lambda x, y: F.abs(x["v"] - y["v"]) <= 2, 5)
    return got.select("grp", F.array_join(F.transform("picked", lambda y: y["id"].cast("string")), ",").alias("picked"))


@query("""WITH RECURSIVE p AS (SELECT p_type AS cluster, p_partkey AS id, string_split(p_name, ' ') AS w FROM part), d AS (SELECT DISTINCT cluster, id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS w FROM p), f AS (SELECT cluster, w, count(*) AS n FROM d GROUP BY ALL),
a AS (SELECT w, sum(n) AS t FROM f GROUP BY w), z AS (SELECT cluster, sum(n) AS size FROM f GROUP BY cluster), m AS (SELECT avg(size) AS mean FROM z), s AS (SELECT cluster, w, round(n / size * ln(1 + mean / t), 8)::DOUBLE AS score FROM f JOIN a USING (w) JOIN z USING (cluster), m),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, w) AS i FROM s),
g AS (SELECT cluster, 1 AS i, [{w: w, score: score}] AS taken FROM r WHERE i = 1 UNION ALL SELECT g.cluster, t.i, CASE WHEN len(taken) < 4 AND len(list_filter(taken, lambda x: contains(' ' || x.w || ' ', ' ' || t.w || ' ') OR contains(' ' || t.w || ' ', ' ' || x.w || ' '))) = 0 THEN list_append(taken, {w: t.w, score: t.score}) ELSE taken END FROM g JOIN r t ON t.cluster = g.cluster AND t.i = g.i + 1)
SELECT cluster, x.w AS term, x.score AS score FROM (SELECT cluster, unnest(arg_max(taken, i)) AS x FROM g GROUP BY cluster)""")
def cluster_terms(spark, d):
    """Class-based tf-idf over words and pairs of words: a term's part of its cluster against its sum over all; the best four of which none holds another."""
    p = t(spark, d, "part").select(F.col("p_type").alias("cluster"), F.split("p_name", " ").alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    x = p.select("cluster", F.explode(F.array_distinct(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))))).alias("w"))
    f = x.groupBy("cluster", "w").agg(F.count("*").alias("n"))
    z = f.groupBy("cluster").agg(F.sum("n").alias("size"))
    s = f.join(f.groupBy("w").agg(F.sum("n").alias("t")), "w").join(z, "cluster").crossJoin(F.broadcast(z.agg(F.avg("size").alias("mean"))))  # one row
    s = cut(s.select("cluster", "w", F.round(F.col("n") / F.col("size") * F.log1p(F.col("mean") / F.col("t")), 8).alias("score")), "terms")
    held = lambda a, b: F.contains(F.concat(F.lit(" "), a["w"], F.lit(" ")), F.concat(F.lit(" "), b["w"], F.lit(" ")))
    got = greedy_picks(s, "cluster", [-F.col("score"), F.col("w")], ["w", "score"], lambda a, b: held(a, b) | held(b, a), 4)
    return got.select("cluster", F.inline("picked")).select("cluster", F.col("w").alias("term"), "score")


_CLAIMS = r"""(SELECT DISTINCT id, CASE WHEN ends_with(m, '%') THEN 'percent' ELSE 'plain' END AS unit, regexp_extract(m, '^[0-9.]+')::DOUBLE AS value FROM (SELECT {id} AS id, unnest(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?(?: ?%)?', 0)) AS m FROM {table}))"""
_IDLE = "unit = 'plain' AND value % 1 = 0 AND (value < 10 OR value BETWEEN 1900 AND 2100)"


@query(f"""WITH c AS (SELECT * FROM {_CLAIMS.format(id='doc_id', table='documents')} WHERE NOT ({_IDLE})), e AS (SELECT DISTINCT unit, value AS held FROM {_CLAIMS.format(id='item_id', table='benchmark')} WHERE NOT ({_IDLE})),
n AS (SELECT c.unit, c.value, min(abs(value - held)) AS far FROM (SELECT DISTINCT unit, value FROM c) c JOIN e ON e.unit = c.unit AND abs(value - held) <= greatest(value, held) * 0.01 GROUP BY ALL)
SELECT c.id AS doc_id, c.unit, c.value, CASE WHEN far IS NULL THEN 'none' WHEN far = 0 THEN 'exact' ELSE 'rounded' END AS verdict FROM c LEFT JOIN n ON n.unit = c.unit AND n.value = c.value""")
def verified_numbers(spark, d):
    """Every number that a document claims, held against the numbers of the benchmark's texts."""
    claims = V.numbers(t(spark, d, "documents"), "doc_id", F.col("text"))
    return V.check_numbers(claims, V.numbers(t(spark, d, "benchmark"), "item_id", F.col("text"))).select("doc_id", "unit", "value", "verdict")
