"""Joins beyond equality: pairs, prefixes, intervals, tolerances, nearest rows, as-of."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions.dates import epoch_seconds
from augury.functions.vectors import cosine
from augury.operators import relational as R
from augury.operators import resolve as V

from .catalog import query, t

#: One vector a label: the labels' fixed representatives (ten rows).
_CENTRES = "SELECT label, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY label"
_COS = "list_cosine_similarity(embedding::DOUBLE[], c::DOUBLE[])"


def centres(spark, d):
    return t(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))


@query("""SELECT a, b, count(*) AS n FROM (SELECT DISTINCT x.l_orderkey, pa.p_brand AS a, pb.p_brand AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey
JOIN part pa ON pa.p_partkey = x.l_partkey JOIN part pb ON pb.p_partkey = y.l_partkey WHERE pa.p_brand < pb.p_brand) GROUP BY ALL""")
def cooccurrence_pairs(spark, d):
    li = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return R.pairs_within(li, "l_orderkey", "p_brand").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("""SELECT a, b, y, count(*) AS n FROM (SELECT DISTINCT x.l_orderkey, year(o_orderdate)::INT AS y, pa.p_size AS a, pb.p_size AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey JOIN orders ON o_orderkey = x.l_orderkey
JOIN part pa ON pa.p_partkey = x.l_partkey JOIN part pb ON pb.p_partkey = y.l_partkey WHERE pa.p_size < pb.p_size) GROUP BY ALL""")
def pair_year_counts(spark, d):
    li = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    # the year comes before the pairs, so that pairs are only counted where they are made
    dated = li.join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.year("o_orderdate").alias("y"), "p_size")
    return R.pairs_within(dated, ["l_orderkey", "y"], "p_size").groupBy("a", "b", "y").agg(F.count("*").alias("n"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON starts_with(a.p_name, b.p_name) AND a.p_partkey <> b.p_partkey AND a.p_type = b.p_type""")
def prefix_theta_join(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_type")
    names = p.select("p_type", F.col("p_name").alias("na")).distinct()
    # a name can only start with one of its own prefixes: an equi-join on those; rows meet by their names afterwards
    a = names.select("p_type", "na", F.explode(F.transform(F.sequence(F.lit(0), F.length("na")), lambda i: F.substring("na", F.lit(1), i))).alias("nb"))
    return V.rows_of_pairs(a.join(names.withColumnRenamed("na", "nb"), ["nb", "p_type"]), p, "p_partkey", "p_name", ["p_type"], keep=lambda a, b: a != b).select("a", "b")


@query("""SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND abs(datediff('day', x.o_orderdate, y.o_orderdate)) <= 120
AND abs(x.o_totalprice - y.o_totalprice) <= 0.15 * greatest(x.o_totalprice, y.o_totalprice)""")
def interval_tolerance_join(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"), "o_totalprice")
    x, y = (o.select("o_custkey", F.col("o_orderkey").alias(k), F.col("day").alias(f"day_{k}"), F.col("o_totalprice").alias(f"p_{k}")) for k in "ab")
    near = R.tolerance_join(x, y, "o_custkey", "day_a", "day_b", 120)
    return near.where((F.col("a") < F.col("b")) & (F.abs(F.col("p_a") - F.col("p_b")) <= 0.15 * F.greatest("p_a", "p_b"))).select("a", "b")


@query(f"""SELECT vec_id, c.label AS nearest, round({_COS}, 4) AS score FROM embeddings e, ({_CENTRES}) c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_COS} DESC, c.label) = 1""")
def lateral_top1_centroid(spark, d):
    c = F.broadcast(centres(spark, d).withColumnRenamed("label", "nearest"))  # ten rows
    s = t(spark, d, "embeddings").select("vec_id", "embedding").crossJoin(c).select("vec_id", "nearest", cosine("embedding", "c").alias("s"))
    return s.groupBy("vec_id").agg(F.min_by("nearest", F.struct(-F.col("s"), F.col("nearest"))).alias("nearest"), F.round(F.max("s"), 4).alias("score"))


@query(f"""SELECT vec_id, c.label AS class, row_number() OVER (PARTITION BY vec_id ORDER BY {_COS} DESC, c.label)::INT AS rank FROM embeddings e, ({_CENTRES}) c QUALIFY rank <= 3""")
def lateral_topk_class(spark, d):
    c = F.broadcast(centres(spark, d).withColumnRenamed("label", "class"))  # ten rows
    s = t(spark, d, "embeddings").select("vec_id", "embedding").crossJoin(c).select("vec_id", "class", cosine("embedding", "c").alias("s"))
    return R.first_per_key(s, ["vec_id"], [F.desc("s"), F.col("class")], 3, "rank").select("vec_id", "class", "rank")


@query("""SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def near_duplicate_pairs(spark, d):
    return V.cosine_pairs(t(spark, d, "embeddings"), "vec_id", "embedding", 0.4, group="label")


@query("""SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def near_duplicate_pairs_all_labels(spark, d):
    """All pairs of the table, whatever their labels."""
    return V.cosine_pairs(t(spark, d, "embeddings"), "vec_id", "embedding", 0.4)


@query("""SELECT e.event_id, (SELECT arg_max(p.value, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts - INTERVAL 24 HOUR) AS value_before FROM events e WHERE e.event_type = 'error'""")
def asof_latest_sample(spark, d):
    e = t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    held = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 24 HOUR"))
    return R.asof_latest(e.where("event_type = 'error'").select("event_id", "ts", "user_id"), held, "user_id", "ts", "value", "value_before").select("event_id", "value_before")


@query("""WITH s AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 AS b FROM events WHERE event_type = 'purchase')
SELECT x.event_id AS x, y.event_id AS y FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.a < y.b AND y.a < x.b""")
def interval_overlap(spark, d):
    s = t(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", epoch_seconds("ts").alias("a"))
    x, y = (s.select("user_id", F.col("event_id").alias(k), F.col("a").alias(f"a_{k}")) for k in "xy")
    return R.tolerance_join(x, y, "user_id", "a_x", "a_y", 3600).where("x < y AND a_x < a_y + 3600 AND a_y < a_x + 3600").select("x", "y")


@query("""SELECT o_orderkey, p_partkey FROM orders JOIN part ON p_partkey = try_cast(regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS BIGINT) + o_orderkey % 10""")
def parsed_number_join(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (F.regexp_extract("o_orderpriority", "^([0-9]+)", 1).try_cast("long") + F.col("o_orderkey") % 10).alias("p_partkey"))
    return o.join(t(spark, d, "part").select("p_partkey"), "p_partkey").select("o_orderkey", "p_partkey")


@query("""SELECT a, b, count(*) AS n FROM (SELECT c.c_mktsegment AS a, s.s_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey JOIN supplier s ON s_suppkey = l_suppkey) GROUP BY ALL ORDER BY n DESC, a, b LIMIT 30""")
def citation_flows(spark, d):
    e = (t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
         .join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")))
    return e.groupBy(F.col("c_mktsegment").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(30)


@query("""SELECT vec_id, c.label AS nearest FROM embeddings e, (""" + _CENTRES + f""") c WHERE {_COS} >= 0.3 + 0.01 * c.label QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_COS} DESC, c.label) = 1""")
def nearest_above_own_threshold(spark, d):
    c = F.broadcast(centres(spark, d).withColumnRenamed("label", "nearest"))  # ten rows
    s = t(spark, d, "embeddings").select("vec_id", "embedding").crossJoin(c).select("vec_id", "nearest", cosine("embedding", "c").alias("s")).where("s >= 0.3 + 0.01 * nearest")
    return s.groupBy("vec_id").agg(F.min_by("nearest", F.struct(-F.col("s"), F.col("nearest"))).alias("nearest"))
