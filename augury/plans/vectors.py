"""Vector analytics over embeddings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.vectors import cosine, norm, prefix
from augury.operators import blocks as B
from augury.operators import cluster as K
from augury.operators import density as D
from augury.operators.gram import projection

from .catalog import query, t
from .joins import _CENTRES, _COS, centres


@query("""SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 5) AS m1, round(avg(embedding[2]::DOUBLE), 5) AS m2, round(avg(embedding[64]::DOUBLE), 5) AS m64 FROM embeddings GROUP BY label""")
def group_mean_vectors(spark, d):
    m = K.mean_vectors(t(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", "n", *(F.round(F.col("mean")[i - 1], 5).alias(f"m{i}") for i in (1, 2, 64)))


@query("""WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY label, i) AS v FROM x) SELECT vec_id, round(max(CASE WHEN i = 1 THEN v END) / sqrt(sum(v * v)), 5) AS first, round(max(v) / sqrt(sum(v * v)), 5) AS top FROM c GROUP BY vec_id""")
def tier_centering(spark, d):
    c = K.centred(t(spark, d, "embeddings"), "label", "embedding")
    return c.select("vec_id", F.round(F.col("embedding")[0], 5).alias("first"), F.round(F.array_max("embedding"), 5).alias("top"))


@query()
def kmeans_cosine(spark, d):
    return K.cosine_kmeans(t(spark, d, "embeddings"), "embedding", 10)[0].select("vec_id", "cluster")


@query()
def pockets(spark, d):
    return K.pockets(t(spark, d, "embeddings"), "vec_id", "embedding", 20, 10, 0.4)


@query()
def pca_3d(spark, d):
    return K.pca(t(spark, d, "embeddings"), "embedding", 3).select("vec_id", "projected")


@query(f"""WITH s AS (SELECT vec_id, c.label AS c, {_COS} AS s FROM embeddings e, ({_CENTRES}) c) SELECT (vec_id % 12)::BIGINT AS month, c AS nest, count(*) AS hits, count(DISTINCT vec_id % 7) AS actors FROM s WHERE s >= 0.3 GROUP BY ALL""")
def history_scan(spark, d):
    c = F.broadcast(centres(spark, d).withColumnRenamed("label", "nest"))  # ten rows
    s = t(spark, d, "embeddings").select("vec_id", "embedding").crossJoin(c).where(cosine("embedding", "c") >= 0.3)
    return s.groupBy((F.col("vec_id") % 12).alias("month"), "nest").agg(F.count("*").alias("hits"), F.count_distinct(F.col("vec_id") % 7).alias("actors"))


_SCORED = f"SELECT vec_id, e.label = 3 AS y, round({_COS}, 6) AS s FROM embeddings e, (SELECT c FROM ({_CENTRES}) WHERE label = 3)"


def _scored(spark, d):
    c = F.broadcast(centres(spark, d).where("label = 3").select("c"))  # one row
    return t(spark, d, "embeddings").crossJoin(c).select("vec_id", (F.col("label") == 3).alias("y"), F.round(cosine("embedding", "c"), 6).alias("s"))


@query(f"""SELECT th::DOUBLE AS threshold, count(*) FILTER (WHERE s >= th AND y) AS tp, count(*) FILTER (WHERE s >= th AND NOT y) AS fp, count(*) FILTER (WHERE s < th AND y) AS fn FROM ({_SCORED}), (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]) AS th) GROUP BY th""")
def threshold_sweep(spark, d):
    return K.threshold_sweep(_scored(spark, d), "s", F.col("y"), [0.1, 0.2, 0.3, 0.4, 0.5])


@query(f"""SELECT round(quantile_cont(s, 0.2) FILTER (WHERE y), 4) AS at_recall80, (SELECT round(min(s), 4) FROM (SELECT s, sum(y::INT) OVER w AS tp, count(*) OVER w AS n FROM ({_SCORED}) WINDOW w AS (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE tp / n >= 0.5) AS at_precision50 FROM ({_SCORED})""")
def probe_thresholds(spark, d):
    s = _scored(spark, d)
    # cumulated over distinct scores, coarse ones first, so that no window sees all rows
    by = s.groupBy("s").agg(F.count("*").alias("n"), F.count_if("y").alias("p")).withColumn("b", F.floor(F.col("s") * 50))
    block = by.groupBy("b").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))  # a hundred blocks at most
    above = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    block = block.select("b", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"))
    run = W.partitionBy("b").orderBy(F.desc("s"))
    cum = by.withColumns({"rn": F.sum("n").over(run), "rp": F.sum("p").over(run)}).join(block, "b").where((F.col("rp") + F.col("ap")) / (F.col("rn") + F.col("an")) >= 0.5)
    return s.agg(F.round(F.percentile(F.when(F.col("y"), F.col("s")), 0.2), 4).alias("at_recall80")).crossJoin(cum.agg(F.round(F.min("s"), 4).alias("at_precision50")))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, embedding[1:16]::DOUBLE[] AS w FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS i,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.w, b.w), 12) DESC, b.vec_id) AS j FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT a AS vec_id, count(*) FILTER (WHERE i <= 10 AND j <= 10) AS kept FROM p GROUP BY a""")
def knn_preservation(spark, d):
    """The stated queries (ids divisible by 50) against all rows, in the whole space and in the first 16 dimensions."""
    rows = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), prefix("embedding", 16).alias("w"))
    asked = rows.where("vec_id % 50 = 0")
    v, w = (K.nearest_in_blocks(rows, asked, "vec_id", c, 10).select("query_id", "vec_id") for c in "vw")
    kept = v.join(w, ["query_id", "vec_id"]).groupBy("query_id").agg(F.count("*").alias("kept"))
    return asked.select(F.col("vec_id").alias("query_id")).join(kept, "query_id", "left").select(F.col("query_id").alias("vec_id"), F.coalesce("kept", F.lit(0)).alias("kept"))


@query("""WITH l AS (SELECT label AS a, (vec_id % 5)::INT + CASE WHEN label > 5 THEN 10 ELSE 0 END AS b FROM embeddings), n AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM n),
ra AS (SELECT sum(s * (s - 1) / 2) AS r FROM (SELECT sum(n) AS s FROM n GROUP BY a)), rb AS (SELECT sum(s * (s - 1) / 2) AS r FROM (SELECT sum(n) AS s FROM n GROUP BY b))
SELECT round((i - ra.r * rb.r / (t * (t - 1) / 2)) / ((ra.r + rb.r) / 2 - ra.r * rb.r / (t * (t - 1) / 2)), 6) AS ari FROM i, ra, rb""")
def adjusted_rand(spark, d):
    e = t(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 5 + F.when(F.col("label") > 5, 10).otherwise(0)).alias("b"))
    return K.adjusted_rand(e, "a", "b").select(F.round("ari", 6).alias("ari"))


@query(f"""WITH w AS (SELECT (vec_id % 2)::INT AS win, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT win, label, i, avg(v) AS v FROM w GROUP BY ALL), l AS (SELECT win, label, list(v ORDER BY i) AS v FROM m GROUP BY ALL),
p AS (SELECT a.label AS a, b.label AS b, list_cosine_similarity(a.v, b.v) AS s FROM l a JOIN l b ON a.win = 0 AND b.win = 1 AND list_cosine_similarity(a.v, b.v) >= 0.05), o AS (SELECT a, count(*) AS k FROM p GROUP BY a), n AS (SELECT b, count(*) AS k FROM p GROUP BY b)
SELECT a, b, CASE WHEN o.k > 1 AND n.k > 1 THEN 'split_merge' WHEN o.k > 1 THEN 'split' WHEN n.k > 1 THEN 'merge' ELSE 'continue' END AS kind FROM p JOIN o USING (a) JOIN n USING (b)""")
def lineage(spark, d):
    m = K.mean_vectors(t(spark, d, "embeddings").withColumn("win", F.col("vec_id") % 2), ["win", "label"], "embedding")
    old, new = (m.where(F.col("win") == i).select(F.col("label").alias(k), F.col("mean").alias(f"m{k}")) for i, k in enumerate("ab"))
    p = old.crossJoin(F.broadcast(new)).where(cosine("ma", "mb") >= 0.05)  # ten centres a window
    p = p.withColumns({"o": F.count("*").over(W.partitionBy("a")), "n": F.count("*").over(W.partitionBy("b"))})
    return p.select("a", "b", F.when((F.col("o") > 1) & (F.col("n") > 1), "split_merge").when(F.col("o") > 1, "split").when(F.col("n") > 1, "merge").otherwise("continue").alias("kind"))


@query(f"""SELECT vec_id, label, CASE WHEN list_contains(top, label) THEN label END AS kept FROM (SELECT vec_id, e.label, array_agg(c.label ORDER BY {_COS} DESC, c.label)[1:2] AS top FROM embeddings e, ({_CENTRES}) c GROUP BY vec_id, e.label)""")
def label_in_top2(spark, d):
    c = F.broadcast(centres(spark, d).withColumnRenamed("label", "class"))  # ten rows
    s = t(spark, d, "embeddings").crossJoin(c).withColumn("s", cosine("embedding", "c"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), F.col("class").alias("class")))), 1, 2), lambda x: x["class"])
    return s.groupBy("vec_id", "label").agg(top.alias("top")).select("vec_id", "label", F.when(F.array_contains("top", F.col("label")), F.col("label")).alias("kept"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS len, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding[1:8]::DOUBLE[], lambda x: x * x))), 4) AS first8 FROM embeddings""")
def prefix_vectors(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(norm("embedding"), 4).alias("len"), F.round(prefix("embedding", 8)[0], 4).alias("first8"))


@query()
def nest_groups(spark, d):
    """Nests of a fine partition, the denser three quarters of its cells, united by closest pairs, in groups by average linkage. Cells are given by
    label and id here, so that plain loops can hold the result."""
    from augury.operators.nests import find_nests

    e = t(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") * 4 + F.col("vec_id") % 4).alias("cell"))
    return find_nests(e, id_col="vec_id", vec_col="embedding", cell_col="cell", cohesion=0.0, quantile=0.25, raw=0.5, centred=0.3, least=8)[1]


@query("""WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(CASE WHEN a.vec_id <> b.vec_id THEN list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END) AS far FROM embeddings a, embeddings b GROUP BY ALL),
s AS (SELECT vec_id, own AS cluster, max(far) FILTER (WHERE own = other) AS a, min(far) FILTER (WHERE own <> other) AS b FROM p GROUP BY vec_id, own)
SELECT vec_id, cluster::BIGINT AS cluster, round(a, 6) AS a, round(b, 6) AS b, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""")
def silhouette_of_clusters(spark, d):
    """Every row's silhouette in given clusters."""
    s = B.silhouettes(t(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return s.select(F.col("id").alias("vec_id"), "cluster", *(F.round(c, 6).alias(c) for c in ("a", "b", "silhouette")))


@query()
def silhouette_choice(spark, d):
    """The mean silhouette of each number of clusters, and which is chosen."""
    best, means = B.pick_k(t(spark, d, "embeddings"), "vec_id", "embedding", 8, 10)
    return spark.createDataFrame([(k, round(s, 6), k == best) for k, s in means.items()], "k int, silhouette double, chosen boolean")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, embedding[1:16]::DOUBLE[] AS w FROM embeddings), p AS (SELECT a.vec_id AS q, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS i, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.w, b.w), 9), b.vec_id) AS j
FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT q AS vec_id, count(*) FILTER (WHERE i <= 10 AND j <= 10)::INT AS kept, coalesce(sum(i - 10) FILTER (WHERE i > 10 AND j <= 10), 0)::BIGINT AS penalty FROM p GROUP BY q""")
def intruding_neighbours(spark, d):
    """The stated queries (ids divisible by 50) against all rows: neighbours that a projection to 16 dimensions keeps, and the ranks beyond ten
    of those that it brings in."""
    e = t(spark, d, "embeddings").select("vec_id", "embedding", F.slice("embedding", 1, 16).alias("low"))
    return B.neighbourhoods_kept(e, "vec_id", "embedding", "low", F.col("vec_id") % 50 == 0, 10).withColumnRenamed("id", "vec_id")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, o_orderdate AS day FROM embeddings JOIN orders ON o_orderkey = vec_id), p AS (SELECT a.vec_id, b.vec_id AS best, round(list_cosine_similarity(a.v, b.v), 9) AS near FROM e a JOIN e b ON date_diff('day', b.day, a.day) BETWEEN 0 AND 30 AND (b.day < a.day OR b.vec_id < a.vec_id) AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY near DESC, best) AS i FROM p) SELECT e.vec_id, best, near, coalesce(near > 0.25, false) AS repeats FROM e LEFT JOIN r ON r.vec_id = e.vec_id AND i = 1""")
def repeats_of_the_month(spark, d):
    """Whether a row repeats one of the thirty days before it: the nearest of those, against a threshold."""
    dated = t(spark, d, "embeddings").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("vec_id"), "o_orderdate"), "vec_id")
    found = B.nearest_before(dated, "vec_id", "embedding", F.unix_date(F.col("o_orderdate").cast("date")), 30)
    return found.select(F.col("id").alias("vec_id"), "best", "near", F.coalesce(F.col("near") > 0.25, F.lit(False)).alias("repeats"))


@query()
def gram_projection(spark, d):
    """Rows in three dimensions, on the leading eigenvectors of their Gram matrix."""
    return projection(t(spark, d, "embeddings"), "vec_id", "embedding")[0].select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


@query()
def density_clusters(spark, d):
    """Clusters of every density, the most stable ones; -1 is noise."""
    return D.density_clusters(t(spark, d, "embeddings"), "vec_id", "embedding", least=5, core=3)


@query()
def reduced_partition(spark, d):
    """k-means on vectors brought to eight dimensions by the Gram projection."""
    placed = projection(t(spark, d, "embeddings"), "vec_id", "embedding", 8)[0]
    return K.cosine_kmeans(placed, "projected", 8)[0].select("vec_id", "cluster")
