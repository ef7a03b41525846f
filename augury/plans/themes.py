"""Themes: checks against centroids, confidences, probes, lineages, sampling by ceilings, digests and lookups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.lineage import cut
from augury.functions.scores import ratio
from augury.functions.vectors import cosine
from augury.operators import graph as G
from augury.operators import heads as H
from augury.operators import sampling as M
from augury.operators.stages import Manifest, files_digest

from .catalog import query, t
from .vectors import _CENTRES, centres


@query(f"""SELECT vec_id, e.label, round(list_cosine_similarity(embedding::DOUBLE[], c.c), 6) AS s, list_cosine_similarity(embedding::DOUBLE[], c.c) >= 0.1 AS corroborated FROM embeddings e JOIN ({_CENTRES}) c ON c.label = e.label""")
def theme_check(spark, d):
    """Whether a row's vector bears out the theme it was given."""
    c = F.broadcast(centres(spark, d))  # ten rows
    s = t(spark, d, "embeddings").join(c, "label").withColumn("s", cosine("embedding", "c"))
    return s.select("vec_id", "label", F.round("s", 6).alias("s"), (F.col("s") >= 0.1).alias("corroborated"))


@query(f"""WITH s AS (SELECT vec_id, c.label AS k, exp(10 * list_cosine_similarity(embedding::DOUBLE[], c.c)) AS x FROM embeddings, ({_CENTRES}) c), p AS (SELECT vec_id, k, x / sum(x) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY round(x, 9) DESC, k) AS i FROM s)
SELECT vec_id, any_value(k) FILTER (WHERE i = 1 AND p >= 0.15) AS first, any_value(k) FILTER (WHERE i = 2) AS second, round(max(p) FILTER (WHERE i = 1), 6) AS confidence, round(max(p) FILTER (WHERE i = 1) - max(p) FILTER (WHERE i = 2), 6) AS margin, count(*) FILTER (WHERE p >= 0.12) AS labels FROM p GROUP BY vec_id""")
def head_scores(spark, d):
    """Linear heads over all classes: softmax confidence, the two best, abstention under a threshold, several labels."""
    c = centres(spark, d).agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("heads"))  # one row of ten heads
    e = t(spark, d, "embeddings").crossJoin(F.broadcast(c))
    xs = F.transform("heads", lambda h: F.struct(F.exp(cosine("embedding", h["c"]) * 10).alias("x"), h["label"].alias("k")))
    e = e.select("vec_id", xs.alias("xs")).withColumn("total", F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["x"]))
    ranked = F.array_sort(F.transform("xs", lambda x: F.struct((-F.round(x["x"], 9)).alias("o"), x["k"].alias("k"), (x["x"] / F.col("total")).alias("p"))))
    e = e.select("vec_id", ranked.alias("r"))
    p = lambda i: F.col("r")[i]["p"]
    return e.select("vec_id", F.when(p(0) >= 0.15, F.col("r")[0]["k"]).alias("first"), F.col("r")[1]["k"].alias("second"), F.round(p(0), 6).alias("confidence"), F.round(p(0) - p(1), 6).alias("margin"), F.size(F.filter("r", lambda x: x["p"] >= 0.12)).cast("long").alias("labels"))


@query(f"""WITH s AS (SELECT e.label, list_cosine_similarity(embedding::DOUBLE[], c.c) AS s, (vec_id % 2)::INT AS win FROM embeddings e JOIN ({_CENTRES}) c ON c.label = e.label), m AS (SELECT label, count(*) AS n, avg(s) AS cohesion, count(*) FILTER (WHERE win = 1) / count(*) AS recent FROM s GROUP BY label)
SELECT label, n, round(cohesion, 6) AS cohesion, round(recent, 6)::DOUBLE AS recent, round(0.4 * n / (SELECT max(n) FROM m) + 0.4 * cohesion + 0.2 * recent, 6)::DOUBLE AS mega_score FROM m""")
def cluster_metrics(spark, d):
    c = F.broadcast(centres(spark, d))
    m = t(spark, d, "embeddings").join(c, "label").groupBy("label").agg(F.count("*").alias("n"), F.avg(cosine("embedding", "c")).alias("cohesion"), (F.count_if(F.col("vec_id") % 2 == 1) / F.count("*")).alias("recent"))
    m = m.crossJoin(F.broadcast(m.agg(F.max("n").alias("top"))))  # one row
    return m.select("label", "n", F.round("cohesion", 6).alias("cohesion"), F.round("recent", 6).alias("recent"), F.round(F.col("n") / F.col("top") * 0.4 + F.col("cohesion") * 0.4 + F.col("recent") * 0.2, 6).alias("mega_score"))


def probe_rows(spark, d):
    """Embeddings with the class that a probe is to find, in two tiers."""
    e = t(spark, d, "embeddings")
    return H.directed(e, id_col="vec_id", vec_col="embedding", tier=F.col("vec_id") % 2, probe=(F.col("label") == 3).cast("int").cast("string"))


@query()
def domain_probe(spark, d):
    """A logistic probe for one class, fitted on six tenths of the rows; each tier's threshold where two other tenths' seeds reach
    a recall of 0.8; recall, false positives and the precision at the tier's own share of seeds on the last two tenths."""
    rows = probe_rows(spark, d)
    told = H.train(rows, ["probe"], recall=0.8).members(rows).join(rows.select("id", (F.col("probe") == "1").alias("y")), "id")
    share = told.groupBy("tier").agg(F.avg(F.col("y").cast("double")).alias("share"))
    hit, y = F.col("member"), F.col("y")
    judged = told.where("part = 'judge'").groupBy("tier").agg(F.count("*").alias("judged"), F.count_if(y).alias("positives"), ratio(F.count_if(hit & y), F.count_if(y)).alias("recall"), ratio(F.count_if(hit & ~y), F.count_if(~y)).alias("false_positive_rate"))
    tp, fp = F.col("recall") * F.col("share"), F.col("false_positive_rate") * (1 - F.col("share"))
    figures = {"recall": F.col("recall"), "false_positive_rate": F.col("false_positive_rate"), "precision_at_prevalence": ratio(tp, tp + fp)}
    return judged.join(F.broadcast(share), "tier").select("tier", "judged", "positives", *(F.round(c, 6).alias(n) for n, c in figures.items()))  # a row a tier


@query()
def stored_heads(spark, d):
    """Two heads trained, stored, read again and asked about every row: answers under the heads' thresholds are withheld. The tables
    are found again by the embeddings' files."""
    e, m = t(spark, d, "embeddings"), Manifest(spark)
    rows = H.directed(e, id_col="vec_id", vec_col="embedding", tier=F.col("vec_id") % 2, theme=F.col("label").cast("string"), upper=(F.col("label") > 4).cast("int").cast("string"))
    key = m.key("heads", files_digest(e), {"targets": ["theme", "upper"], "accuracy": 0.6})
    if (path := m.find("heads", key)) is None:
        path = m.place("heads")
        H.train(rows, ["theme", "upper"], accuracy=0.6).save(path)
        m.finish("heads", key, path)
    told = H.Heads.load(spark, path).answers(rows)
    return told.select(F.col("id").alias("vec_id"), "head", "answer", "first", "second", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))


@query("""WITH n AS (SELECT o_custkey AS k, o_orderkey AS id, year(o_orderdate) AS y, o_totalprice AS v FROM orders), s AS (SELECT a.id, arg_min(b.id, (abs(b.v - a.v), b.id)) AS next FROM n a JOIN n b ON a.k = b.k AND b.y = a.y + 1 GROUP BY a.id), w AS (SELECT next, arg_min(id, (v2, id)) AS prev FROM (SELECT s.id, s.next, abs(a.v - b.v) AS v2 FROM s JOIN n a ON a.id = s.id JOIN n b ON b.id = s.next) GROUP BY next),
r AS (SELECT id, id AS head, 0 AS step FROM n WHERE id NOT IN (SELECT next FROM w) UNION ALL SELECT w.next, r.head, r.step + 1 FROM r JOIN w ON w.prev = r.id) SELECT id, head, step::BIGINT AS step FROM r""".replace("WITH n AS", "WITH RECURSIVE n AS"))
def lineage_threads(spark, d):
    """Chains through the best successor of the next year (each taken once, by its nearest): the head of each chain and
    the place in it, by pointer jumping, so that rounds grow with the logarithm of the longest chain."""
    n = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("v"))
    b = n.select("k", F.col("id").alias("next"), (F.col("y") - 1).alias("y"), F.col("v").alias("nv"))
    s = n.join(b, ["k", "y"]).groupBy("id", "v").agg(F.min(F.struct(F.abs(F.col("nv") - F.col("v")).alias("d"), "next")).alias("b")).select("id", F.col("b.next").alias("next"), F.col("b.d").alias("d"))
    w = s.groupBy("next").agg(F.min_by("id", F.struct("d", "id")).alias("prev"))
    jumps = cut(n.select("id").join(w.withColumnRenamed("next", "id"), "id", "left").select("id", F.coalesce("prev", "id").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("step")), "threads")
    while True:
        far = jumps.select(F.col("id").alias("head"), F.col("head").alias("beyond"), F.col("step").alias("more"))
        new = cut(jumps.join(far, "head").select("id", F.col("beyond").alias("head"), (F.col("step") + F.col("more")).alias("step"), (F.col("more") > 0).alias("moved")), "threads")
        jumps = new.drop("moved")
        if new.where("moved").isEmpty():
            return jumps


@query("""WITH RECURSIVE b AS (SELECT min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders), c AS (SELECT k, y, (SELECT count(*) FROM orders WHERE o_custkey = k AND year(o_orderdate) = y) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders), (SELECT unnest(range(lo, hi + 1)) AS y FROM b)),
u AS (SELECT k, y, 0.0::DOUBLE AS f, n FROM c, b WHERE y = lo UNION ALL SELECT c.k, c.y, ln(1 + u.n * exp(u.f)), c.n FROM u JOIN c ON c.k = u.k AND c.y = u.y + 1), v AS (SELECT k, y, 0.0::DOUBLE AS f, n FROM c, b WHERE y = hi UNION ALL SELECT c.k, c.y, ln(1 + v.n * exp(v.f)), c.n FROM v JOIN c ON c.k = v.k AND c.y = v.y - 1)
SELECT o_orderkey AS node, round(u.f + v.f, 6) AS through FROM orders JOIN u ON u.k = o_custkey AND u.y = year(o_orderdate) JOIN v ON v.k = o_custkey AND v.y = year(o_orderdate)""")
def path_centrality(spark, d):
    """Paths through a node: the logarithm of those that end at it and of those that begin there, over edges of at most
    a year (the cap is a filter on edges)."""
    n = t(spark, d, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey", F.year("o_orderdate").alias("layer"))
    edges = n.select("o_custkey", F.col("node").alias("src"), (F.col("layer") - 1).alias("layer")).join(n.withColumnRenamed("node", "dst"), ["o_custkey", "layer"]).select("src", "dst")
    back = G.log_path_counts(n.select("node", "layer"), edges).withColumnRenamed("logn", "a")
    ahead = G.log_path_counts(n.select("node", (-F.col("layer")).alias("layer")), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("logn", "b")
    return back.join(ahead, "node").select("node", F.round(F.col("a") + F.col("b"), 6).alias("through"))


@query()
def ceiling_sample(spark, d):
    """About 300 documents in proportion to what sources hold, none above its ceiling, hash-ordered inside a source."""
    return M.capped(t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 300, 40).select("doc_id", "source")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE list_has_any([o_orderpriority, o_orderstatus], ['F', '1-URGENT'])) AS agree FROM orders WHERE left(md5(o_orderkey::VARCHAR), 1) IN ('0', '1', '2', '3')""")
def sampled_agreement(spark, d):
    """A hash sample (the operator here) and how often two lists of codes overlap in it."""
    o = t(spark, d, "orders").where(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1).isin(*"0123"))
    return o.agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap(F.array("o_orderpriority", "o_orderstatus"), F.array(F.lit("F"), F.lit("1-URGENT")))).alias("agree"))


@query("""SELECT o_orderkey AS id, left(o_orderpriority || ' of ' || c_name, 16) AS summary, n_name AS country, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 180 DAY FROM orders)""")
def index_rows(spark, d):
    """Narrow rows of a window: a summary cut where the page cuts it (the feature), two left joins."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    o = o.crossJoin(F.broadcast(o.agg((F.max("o_orderdate") - F.expr("INTERVAL 180 DAY")).alias("since")))).where("o_orderdate >= since")  # one row
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("n_name").alias("country"))
    x = o.join(c, "o_custkey", "left")
    return x.select(F.col("o_orderkey").alias("id"), F.substring(F.concat("o_orderpriority", F.lit(" of "), "c_name"), 1, 16).alias("summary"), "country", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""SELECT a.o_orderkey AS work, b.o_orderkey AS twin FROM orders a JOIN (SELECT min(o_orderkey) AS o_orderkey, lower('https://doi.org/10.1/' || (o_orderkey % 500)) AS url FROM orders GROUP BY 2) b ON b.url = lower('https://DOI.org/10.1/' || (a.o_orderkey % 500))""")
def normalised_key_join(spark, d):
    """A join on addresses in lower case, the other side first brought to one row a key."""
    o = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("https://DOI.org/10.1/"), (F.col("o_orderkey") % 500).cast("string")).alias("url"))
    b = o.groupBy(F.lower("url").alias("key")).agg(F.min("o_orderkey").alias("twin"))
    return o.withColumn("key", F.lower("url")).join(b, "key").select(F.col("o_orderkey").alias("work"), "twin")


@query("""WITH w AS (SELECT *, date_trunc('week', o_orderdate) AS wk, (SELECT date_trunc('week', max(o_orderdate)) FROM orders) AS last FROM orders), m AS (SELECT o_orderpriority AS theme, count(*) FILTER (WHERE wk = last - INTERVAL 7 DAY) AS now, count(*) FILTER (WHERE wk = last - INTERVAL 14 DAY) AS before FROM w GROUP BY 1)
SELECT theme, m.now AS now, m.before AS before, now - before AS momentum, (SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY i) FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM w WHERE wk = last - INTERVAL 7 DAY AND o_orderpriority = theme) WHERE i <= 3) AS top FROM m""")
def week_digest(spark, d):
    """The last whole week: each theme's best three, its size, and its momentum against the week before."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.date_trunc("week", "o_orderdate").cast("date").alias("wk"))
    o = o.crossJoin(F.broadcast(o.agg(F.max("wk").alias("last")))).withColumn("age", F.datediff("last", "wk"))  # one row
    m = o.groupBy(F.col("o_orderpriority").alias("theme")).agg(F.count_if(F.col("age") == 7).alias("now"), F.count_if(F.col("age") == 14).alias("before"))
    first = o.where("age = 7").withColumn("i", F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("i <= 3")
    top = first.groupBy(F.col("o_orderpriority").alias("theme")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("top"))
    return m.join(top, "theme", "left").select("theme", "now", "before", (F.col("now") - F.col("before")).alias("momentum"), "top")


@query(f"""WITH q AS (SELECT c FROM ({_CENTRES}) WHERE label = 2) SELECT (vec_id % 3)::INT AS tier, (vec_id % 7)::INT AS y, count(*) FILTER (WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], c) < 0.95) AS hits, count(*) AS total FROM embeddings, q GROUP BY ALL""")
def projected_tier_years(spark, d):
    """Rows near one stored vector by tier and year, beside all rows."""
    q = F.broadcast(centres(spark, d).where("label = 2").select("c"))  # one row
    e = t(spark, d, "embeddings").crossJoin(q)
    return e.groupBy((F.col("vec_id") % 3).cast("int").alias("tier"), (F.col("vec_id") % 7).cast("int").alias("y")).agg(F.count_if(1 - cosine("embedding", "c") < 0.95).alias("hits"), F.count("*").alias("total"))


@query("""WITH p AS (SELECT p_brand AS k, CASE WHEN avg(p_size) > 25 THEN 'up' ELSE 'down' END AS expected FROM part GROUP BY 1), o AS (SELECT p_brand AS k, CASE WHEN regr_slope(l_quantity, epoch(l_shipdate)) > 0 THEN 'up' ELSE 'down' END AS predicted FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT k, expected, predicted, CASE WHEN predicted IS NULL THEN 'no data' WHEN expected = predicted THEN 'hit' ELSE 'miss' END AS verdict FROM p LEFT JOIN o USING (k)""")
def direction_holdout(spark, d):
    p = t(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(F.when(F.avg("p_size") > 25, "up").otherwise("down").alias("expected"))
    days = F.datediff("l_shipdate", F.lit("1970-01-01"))
    li = t(spark, d, "lineitem").join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("k")), "l_partkey")
    o = li.groupBy("k").agg(F.when(F.regr_slope("l_quantity", days) > 0, "up").otherwise("down").alias("predicted"))
    return p.join(o, "k", "left").select("k", "expected", "predicted", F.when(F.col("predicted").isNull(), "no data").when(F.col("expected") == F.col("predicted"), "hit").otherwise("miss").alias("verdict"))
