"""Trends over years, months and weeks: take-offs, directions, shares of thirds, axes, withheld leads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.scores import ratio

from .catalog import query, t

_YEARLY = "SELECT p_brand AS k, year(l_shipdate) AS y, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def yearly(spark, d):
    """Lines per brand and year."""
    j = t(spark, d, "lineitem").select("l_partkey", "l_shipdate").join(t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("k"), F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS ({_YEARLY}), p AS (SELECT k, max(n) AS peak FROM s GROUP BY k) SELECT k, min(y) FILTER (WHERE n >= 3)::INT AS first_three, min(y) FILTER (WHERE n >= greatest(3, 0.15 * peak))::INT AS ramp, min(y) FILTER (WHERE n >= greatest(3, 0.5 * peak))::INT AS half FROM s JOIN p USING (k) GROUP BY k""")
def takeoff_years(spark, d):
    """First year with three, and first with a share of the peak year (three at least)."""
    s = yearly(spark, d).withColumn("peak", F.max("n").over(W.partitionBy("k")))  # years of one key
    at = lambda cond: F.min(F.when(cond, F.col("y")))
    return s.groupBy("k").agg(at(F.col("n") >= 3).alias("first_three"), at(F.col("n") >= F.greatest(F.lit(3), F.col("peak") * 0.15)).alias("ramp"), at(F.col("n") >= F.greatest(F.lit(3), F.col("peak") * 0.5)).alias("half"))


@query(f"""WITH s AS ({_YEARLY}), t AS (SELECT y, sum(n) AS t FROM s GROUP BY y), b AS (SELECT min(y) AS lo, max(y) AS this FROM t), g AS (SELECT k, y, coalesce(n, 0) AS n, round(1e6 * coalesce(n, 0) / t, 3) AS pm FROM (SELECT DISTINCT k FROM s) CROSS JOIN t LEFT JOIN s USING (k, y)), c AS (SELECT g.*, this, lo, max(CASE WHEN y < this THEN pm END) OVER (PARTITION BY k) AS peak FROM g, b)
SELECT k, min(y) FILTER (WHERE n >= 3)::INT AS first, coalesce(min(y) FILTER (WHERE n >= 3) = any_value(lo), false) AS edge, min(y) FILTER (WHERE y < this AND n >= 3 AND pm >= 0.25 * peak AND peak > 0)::INT AS takeoff,
round(sum(pm) FILTER (WHERE y BETWEEN this - 3 AND this - 1) / nullif(sum(pm) FILTER (WHERE y BETWEEN this - 6 AND this - 4), 0), 2)::DOUBLE AS growth, sum(n)::BIGINT AS total FROM c GROUP BY k""")
def series_summary(spark, d):
    """Per million of the year's total: first year, whether it is the data's first, take-off, and three complete years
    against the three before. The running year decides nothing."""
    s = yearly(spark, d)
    totals = s.groupBy("y").agg(F.sum("n").alias("t"))
    b = F.broadcast(totals.agg(F.min("y").alias("lo"), F.max("y").alias("this")))  # one row
    grid = s.select("k").distinct().crossJoin(F.broadcast(totals))  # brands x years
    g = grid.join(s, ["k", "y"], "left").crossJoin(b).withColumn("n", F.coalesce("n", F.lit(0))).withColumn("pm", F.round(F.col("n") * 1e6 / F.col("t"), 3))
    g = g.withColumn("peak", F.max(F.when(F.col("y") < F.col("this"), F.col("pm"))).over(W.partitionBy("k")))
    when = lambda cond, x: F.when(F.expr(cond), F.col(x))
    out = g.groupBy("k").agg(F.min(when("n >= 3", "y")).alias("first"), F.first("lo").alias("lo"), F.min(when("y < this AND n >= 3 AND pm >= 0.25 * peak AND peak > 0", "y")).alias("takeoff"),
                             F.sum(when("y BETWEEN this - 3 AND this - 1", "pm")).alias("a"), F.sum(when("y BETWEEN this - 6 AND this - 4", "pm")).alias("b"), F.sum("n").alias("total"))
    return out.select("k", "first", F.coalesce(F.col("first") == F.col("lo"), F.lit(False)).alias("edge"), "takeoff", F.round(ratio("a", "b"), 2).alias("growth"), "total")


@query(f"""WITH s AS (SELECT *, max(y) OVER () AS this FROM ({_YEARLY})), r AS (SELECT k, y, n, row_number() OVER (PARTITION BY k ORDER BY y DESC) AS i, count(*) OVER (PARTITION BY k) AS years, sum(n) OVER (PARTITION BY k) AS total FROM s WHERE y < this)
SELECT k, CASE WHEN any_value(total) < 20 OR any_value(years) < 4 THEN 'insufficient_data' WHEN quantile_disc(n, 0.5) < 2 THEN 'uncertain' WHEN regr_slope(n, y) * (max(y) - min(y)) / avg(n) >= 0.2 THEN 'accelerating' WHEN regr_slope(n, y) * (max(y) - min(y)) / avg(n) <= -0.6 THEN 'decelerating'
WHEN regr_slope(n, y) * (max(y) - min(y)) / avg(n) <= -0.2 THEN 'maturing' ELSE 'steady' END AS direction, CASE WHEN any_value(total) >= 20 AND any_value(years) >= 4 THEN round(regr_slope(n, y) * (max(y) - min(y)) / avg(n), 3) END AS rel_change FROM r WHERE i <= 7 GROUP BY k""")
def direction_bands(spark, d):
    """The slope over the last seven complete years times their span, as a part of their mean, in bands; withheld where
    there is too little, and uncertain where the years are thin."""
    s = yearly(spark, d)
    s = s.crossJoin(F.broadcast(s.agg(F.max("y").alias("this")))).where("y < this")  # one row
    r = s.withColumns({"i": F.row_number().over(W.partitionBy("k").orderBy(F.desc("y"))), "years": F.count("*").over(W.partitionBy("k")), "total": F.sum("n").over(W.partitionBy("k"))}).where("i <= 7")
    g = r.groupBy("k").agg(F.first("years").alias("years"), F.first("total").alias("total"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").alias("mid"), (F.regr_slope("n", "y") * (F.max("y") - F.min("y")) / F.avg("n")).alias("rel"))
    thin, rel = (F.col("total") < 20) | (F.col("years") < 4), F.col("rel")
    band = F.when(thin, "insufficient_data").when(F.col("mid") < 2, "uncertain").when(rel >= 0.2, "accelerating").when(rel <= -0.6, "decelerating").when(rel <= -0.2, "maturing").otherwise("steady")
    return g.select("k", band.alias("direction"), F.when(~thin, F.round(rel, 3)).alias("rel_change"))


_MONTHLY = "SELECT o_orderpriority AS k, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, count(*) AS n FROM orders GROUP BY ALL"


def monthly_orders(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("long").alias("m")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS ({_MONTHLY}), t AS (SELECT m, sum(n) AS t, row_number() OVER (ORDER BY m) AS i, count(*) OVER () AS c FROM s GROUP BY m), e AS (SELECT k, 100 * (sum(n) FILTER (WHERE i > c - c // 3) / (SELECT sum(t) FROM t WHERE i > c - c // 3) - sum(n) FILTER (WHERE i <= c // 3) / (SELECT sum(t) FROM t WHERE i <= c // 3)) AS delta FROM s JOIN t USING (m) GROUP BY k)
SELECT k, CASE WHEN (SELECT max(c) FROM t) < 6 THEN 'unknown' WHEN delta > 1 THEN 'rising' WHEN delta < -1 THEN 'declining' ELSE 'stable' END AS tag, round(delta, 1)::DOUBLE AS delta FROM e""")
def share_of_thirds(spark, d):
    """Share of the last third of the months less that of the first, in percentage points."""
    s = monthly_orders(spark, d)
    months = s.groupBy("m").agg(F.sum("n").alias("t"))  # months, not rows
    months = months.withColumns({"i": F.row_number().over(W.partitionBy(F.lit(0)).orderBy("m")), "c": F.count("*").over(W.partitionBy(F.lit(0)))})
    months = months.withColumn("third", F.when(F.expr("i <= c div 3"), "a").when(F.expr("i > c - c div 3"), "z"))
    whole = F.broadcast(months.agg(F.sum(F.when(F.col("third") == "a", F.col("t"))).alias("ta"), F.sum(F.when(F.col("third") == "z", F.col("t"))).alias("tz"), F.max("c").alias("c")))
    e = s.join(F.broadcast(months.select("m", "third")), "m").groupBy("k").agg(*(F.sum(F.when(F.col("third") == x, F.col("n"))).alias(x) for x in "az")).crossJoin(whole)
    delta = (F.col("z") / F.col("tz") - F.col("a") / F.col("ta")) * 100
    return e.select("k", F.when(F.col("c") < 6, "unknown").when(delta > 1, "rising").when(delta < -1, "declining").otherwise("stable").alias("tag"), F.round(delta, 1).alias("delta"))


@query(f"""WITH s AS ({_MONTHLY}), b AS (SELECT max(m) AS hi FROM s), a AS (SELECT k, coalesce(sum(n) FILTER (WHERE m = hi), 0) AS n, coalesce(sum(n) FILTER (WHERE m BETWEEN hi - 4 AND hi - 1), 0) AS p FROM s, b GROUP BY k)
SELECT k, n::BIGINT AS n, p::BIGINT AS prior_n, round(p / 4, 2)::DOUBLE AS prior_mean, CASE WHEN p > 0 THEN round(n / (p / 4), 2) END::DOUBLE AS growth, n >= 5 AND (p = 0 OR n / (p / 4) >= 1.5) AS emerging FROM a""")
def growth_vs_prior(spark, d):
    """The last month against the mean of four before it; emerging from 5 and one and a half times that mean."""
    s = monthly_orders(spark, d)
    s = s.crossJoin(F.broadcast(s.agg(F.max("m").alias("hi"))))  # one row
    a = s.groupBy("k").agg(F.coalesce(F.sum(F.expr("CASE WHEN m = hi THEN n END")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.expr("CASE WHEN m BETWEEN hi - 4 AND hi - 1 THEN n END")), F.lit(0)).alias("prior_n"))
    mean = F.col("prior_n") / 4
    grown = F.when(F.col("prior_n") > 0, F.col("n") / mean)
    return a.select("k", "n", "prior_n", F.round(mean, 2).alias("prior_mean"), F.round(grown, 2).alias("growth"), ((F.col("n") >= 5) & ((F.col("prior_n") == 0) | (grown >= 1.5))).alias("emerging"))


@query("""WITH b AS (SELECT date_trunc('month', max(o_orderdate)) AS hi FROM orders), a AS (SELECT unnest(generate_series(hi - INTERVAL 11 MONTH, hi, INTERVAL 1 MONTH)) AS s FROM b) SELECT strftime(s, '%Y-%m') AS month, strftime(s, '%Y-%m-%d') AS since, strftime(s + INTERVAL 1 MONTH, '%Y-%m-%d') AS until, count(o_orderkey) AS n FROM a LEFT JOIN orders ON o_orderdate >= s AND o_orderdate < s + INTERVAL 1 MONTH GROUP BY s""")
def trailing_month_axis(spark, d):
    """The last twelve months as an axis of intervals, months without rows included."""
    o = t(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("s")).agg(F.count("*").alias("n"))
    axis = o.agg(F.max("s").alias("hi")).select(F.explode(F.expr("sequence(add_months(hi, -11), hi, interval 1 month)")).alias("s"))
    return axis.join(o, "s", "left").select(F.date_format("s", "yyyy-MM").alias("month"), F.date_format("s", "yyyy-MM-dd").alias("since"), F.date_format(F.add_months("s", 1), "yyyy-MM-dd").alias("until"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH s AS ({_YEARLY}), b AS (SELECT min(y) AS lo FROM s), o AS (SELECT k, min(y) AS science FROM s WHERE n >= 3 GROUP BY k), m AS (SELECT p_brand AS k, min(year(o_orderdate)) AS market FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45 GROUP BY 1)
SELECT k, science::INT AS science, market::INT AS market, CASE WHEN science > lo AND market IS NOT NULL THEN market - science END::INT AS lead, science = lo OR market IS NULL AS withheld FROM o LEFT JOIN m USING (k), b""")
def lead_withheld_at_floor(spark, d):
    """Years between two take-offs; withheld where the first is pinned to the data's first year or the second is missing."""
    s = yearly(spark, d)
    j = t(spark, d, "lineitem").where("l_quantity >= 45").select("l_partkey", "l_orderkey").join(t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    m = j.join(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("p_brand").alias("k")).agg(F.min(F.year("o_orderdate")).alias("market"))
    o = s.where("n >= 3").groupBy("k").agg(F.min("y").alias("science")).join(m, "k", "left").crossJoin(F.broadcast(s.agg(F.min("y").alias("lo"))))
    return o.select("k", "science", "market", F.when((F.col("science") > F.col("lo")) & F.col("market").isNotNull(), F.col("market") - F.col("science")).alias("lead"), ((F.col("science") == F.col("lo")) | F.col("market").isNull()).alias("withheld"))


@query("""SELECT o_orderpriority AS k, sum((j->>'$.n')::BIGINT) FILTER (WHERE (j->>'$.y')::INT >= 1996)::DOUBLE / 3 AS velocity, count(*) AS years FROM (SELECT o_orderpriority, to_json({y: year(o_orderdate), n: count(*)}) AS j FROM orders GROUP BY o_orderpriority, year(o_orderdate)) GROUP BY 1""")
def json_velocity(spark, d):
    """A JSON array of yearly counts per key, summed over the recent years by a filter on its elements."""
    by = t(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")).groupBy("o_orderpriority").agg(F.to_json(F.collect_list(F.struct("y", "n"))).alias("j"))
    xs = F.from_json("j", "array<struct<y:int,n:bigint>>")
    return by.select(F.col("o_orderpriority").alias("k"), (F.aggregate(F.filter(xs, lambda x: x["y"] >= 1996), F.lit(0).cast("long"), lambda s, x: s + x["n"]) / 3).alias("velocity"), F.size(xs).cast("long").alias("years"))


@query("""WITH m AS (SELECT event_type AS k, user_id, date_trunc('day', ts)::DATE AS day FROM events), a AS (SELECT k, day, count(*) AS n FROM m GROUP BY ALL) SELECT k, (SELECT count(DISTINCT user_id) FROM m x WHERE x.k = a.k) AS reach, date_diff('day', min(day), max(day)) AS span, date_diff('day', (SELECT min(day) FROM m), min(day)) AS lag, round(count(*) / (date_diff('day', min(day), max(day)) + 1), 6) AS presence, round(max(n) / avg(n), 6) AS hype, strftime(arg_max(day, (n, -epoch(day::TIMESTAMP))), '%Y-%m-%d') AS peak FROM a GROUP BY k""")
def key_measures(spark, d):
    """How many speak of a key, how long, how late after the first, on which part of the days, and how sharp its peak is."""
    m = t(spark, d, "events").select(F.col("event_type").alias("k"), "user_id", F.to_date("ts").alias("day"))
    a = m.groupBy("k", "day").agg(F.count("*").alias("n"))
    reach = m.groupBy("k").agg(F.count_distinct("user_id").alias("reach"))
    g = a.groupBy("k").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count("*").alias("days"), F.max("n").alias("top"), F.avg("n").alias("mean"), F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("peak"))
    g = g.join(reach, "k").crossJoin(F.broadcast(m.agg(F.min("day").alias("first"))))
    return g.select("k", "reach", F.datediff("hi", "lo").cast("long").alias("span"), F.datediff("lo", "first").cast("long").alias("lag"), F.round(F.col("days") / (F.datediff("hi", "lo") + 1), 6).alias("presence"), F.round(F.col("top") / F.col("mean"), 6).alias("hype"), F.date_format("peak", "yyyy-MM-dd").alias("peak"))


@query("""SELECT tier, k, y::INT AS y, count(*) AS n FROM (SELECT 'orders' AS tier, o_orderpriority AS k, year(o_orderdate) AS y FROM orders UNION ALL SELECT 'lines', l_returnflag, year(l_shipdate) FROM lineitem UNION ALL SELECT 'events', event_type, year(ts) FROM events UNION ALL SELECT 'documents', lang, NULL FROM documents) GROUP BY ALL""")
def tier_series_union(spark, d):
    """One series table out of four sources, each aggregated before the union."""
    take = lambda name, k, y: t(spark, d, name).groupBy(F.lit({"lineitem": "lines"}.get(name, name)).alias("tier"), F.col(k).alias("k"), y.alias("y")).agg(F.count("*").alias("n"))
    return take("orders", "o_orderpriority", F.year("o_orderdate")).unionByName(take("lineitem", "l_returnflag", F.year("l_shipdate"))).unionByName(take("events", "event_type", F.year("ts"))).unionByName(take("documents", "lang", F.lit(None).cast("int")))


@query("""SELECT l_returnflag, approx.m AS median_q FROM (SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS m FROM lineitem GROUP BY 1) approx""")
def sketched_median(spark, d):
    """A sketch whose error lies below one row here, so that it equals the exact median by rank."""
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_quantity", 0.5, 1_000_000).alias("median_q"))
