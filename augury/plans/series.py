"""Windows and time series: samples, percentiles, trailing frames, take-off, momentum, lead time."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.dates import month_int, month_key, week_start
from augury.functions.scores import knuth_bucket, per_10k, ratio
from augury.operators import relational as R
from augury.operators import series as S

from .catalog import query, t

_M = "(year(l_shipdate) * 12 + month(l_shipdate) - 1)::BIGINT"
_MONTHLY = f"SELECT l_returnflag AS k, {_M} AS m, count(*) AS n FROM lineitem GROUP BY ALL"


def monthly(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), month_int("l_shipdate").alias("m")).agg(F.count("*").alias("n"))


@query("""SELECT month, o_orderkey FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS h FROM orders) QUALIFY row_number() OVER (PARTITION BY month ORDER BY h, o_orderkey) <= 7""")
def hash_sample_per_month(spark, d):
    o = t(spark, d, "orders").select(month_key("o_orderdate").alias("month"), "o_orderkey", knuth_bucket("o_orderkey", 1 << 32).alias("h"))
    return R.first_per_key(o, ["month"], [F.col("h"), F.col("o_orderkey")], 7).drop("h")


@query("""SELECT month, count(*) AS frame, least(count(*), 10) AS quota, round(count(*) / least(count(*), 10), 6)::DOUBLE AS weight FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders) GROUP BY month""")
def quota_weight(spark, d):
    n = t(spark, d, "orders").groupBy(month_key("o_orderdate").alias("month")).agg(F.count("*").alias("frame")).withColumn("quota", F.least("frame", F.lit(10)))
    return n.withColumn("weight", F.round(F.col("frame") / F.col("quota"), 6))


@query("""SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS pr FROM customer""")
def percent_rank_in_group(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return S.percent_ranks(c, ["c_nationkey"], "c_acctbal", 100.0, "pr").select("c_custkey", F.round("pr", 6).alias("pr"))


@query("""SELECT o_orderkey, round(CASE WHEN count(*) OVER (PARTITION BY y, p) >= 50 THEN (row_number() OVER (PARTITION BY y, p ORDER BY v, o_orderkey) - 0.5) / count(*) OVER (PARTITION BY y, p)
ELSE (row_number() OVER (PARTITION BY y ORDER BY v, o_orderkey) - 0.5) / count(*) OVER (PARTITION BY y) END, 6)::DOUBLE AS pct FROM (SELECT o_orderkey, year(o_orderdate) AS y, o_orderpriority AS p, o_totalprice AS v FROM orders)""")
def cohort_percentile_with_fallback(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"))
    return S.cohort_percentile(o, "v", "o_orderkey", ["y", "p"], ["y"], 50, "pct", 1000.0).select("o_orderkey", F.round("pct", 6).alias("pct"))


@query("""SELECT k, y, CASE WHEN c = 5 AND s >= 100 THEN round(s / 5, 4) END AS mean5 FROM (SELECT k, y, count(*) OVER w AS c, (sum(n) OVER w)::DOUBLE AS s FROM (SELECT l_returnflag AS k, year(l_shipdate)::INT AS y, count(*) AS n FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY k ORDER BY y RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))""")
def trailing_5y_gate(spark, d):
    n = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))
    w = S.trailing(["k"], "y", 4)
    n = n.withColumns({"c": F.count("*").over(w), "s": F.sum("n").over(w)})
    return n.select("k", "y", F.when((F.col("c") == 5) & (F.col("s") >= 100), F.round(F.col("s") / 5, 4)).alias("mean5"))


@query(f"""SELECT k, m, round(now / nullif(before, 0), 6) AS r FROM (SELECT k, m, sum(n) OVER (PARTITION BY k ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS now, sum(n) OVER (PARTITION BY k ORDER BY m RANGE BETWEEN 23 PRECEDING AND 12 PRECEDING) AS before FROM ({_MONTHLY}))""")
def trailing_12m_ratio(spark, d):
    n = monthly(spark, d).withColumns({"now": F.sum("n").over(S.trailing(["k"], "m", 11)), "before": F.sum("n").over(S.trailing(["k"], "m", 23, 12))})
    return n.select("k", "m", F.round(ratio("now", "before"), 6).alias("r"))


@query(f"""SELECT k, m, n, (sum(n) OVER (PARTITION BY k ORDER BY m))::BIGINT AS total FROM ({_MONTHLY})""")
def cumulative_sum(spark, d):
    return monthly(spark, d).withColumn("total", F.sum("n").over(W.partitionBy("k").orderBy("m")))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events""")
def carry_forward(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return S.carried_forward(e, ["user_id"], "at", "v").select("event_id", "v")


@query(f"""SELECT k, round(regr_slope(n, m), 4) AS slope, CASE WHEN regr_slope(n, m) > 0 THEN round((10000 - max(n)) / regr_slope(n, m), 2) END AS periods_left FROM ({_MONTHLY}) GROUP BY k""")
def regr_slope_projection(spark, d):
    g = monthly(spark, d).groupBy("k").agg(F.regr_slope(F.col("n").cast("double"), F.col("m").cast("double")).alias("s"), F.max("n").alias("top"))
    return g.select("k", F.round("s", 4).alias("slope"), F.when(F.col("s") > 0, F.round((10000 - F.col("top")) / F.col("s"), 2)).alias("periods_left"))


@query(f"""SELECT k, min(m) FILTER (WHERE run >= greatest(3, total * 0.1)) AS onset FROM (SELECT k, m, sum(n) OVER (PARTITION BY k ORDER BY m) AS run, sum(n) OVER (PARTITION BY k) AS total FROM ({_MONTHLY})) GROUP BY k""")
def onset_month(spark, d):
    return S.onset(monthly(spark, d), ["k"], "m", "n")


_SHARES = "SELECT k, y, n / sum(n) OVER (PARTITION BY y) AS share FROM (SELECT p_brand AS k, year(l_shipdate)::INT AS y, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def shares(spark, d):
    n = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("k"), F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))
    return n.select("k", "y", (F.col("n") / F.sum("n").over(W.partitionBy("y"))).alias("share"))


@query(f"""WITH s AS ({_SHARES}), p AS (SELECT k, y, share, max(share) OVER (PARTITION BY k) AS peak FROM s), g AS (SELECT k, count(*) AS c, min(CASE WHEN share >= 0.5 * peak THEN y END) AS ty, arg_min(share, y) AS head, max(peak) AS top FROM p GROUP BY k)
SELECT k, CASE WHEN c >= 4 THEN ty END AS takeoff, CASE WHEN c >= 4 THEN head < 0.2 * top END AS genuine FROM g""")
def takeoff_emergence_gate(spark, d):
    return S.takeoff(shares(spark, d), ["k"], "y", "share")


@query(f"""WITH s AS ({_SHARES}), b AS (SELECT min(y) AS lo, max(y) AS hi FROM s), g AS (SELECT k, avg(share) FILTER (WHERE y <= lo + 1) AS early, avg(share) FILTER (WHERE y >= hi - 1) AS late FROM s, b GROUP BY k)
SELECT k, CASE WHEN early IS NULL OR late IS NULL THEN 'unknown' WHEN late > early * 1.05 THEN 'rising' WHEN late < early * 0.95 THEN 'falling' ELSE 'steady' END AS momentum FROM g""")
def momentum_classify(spark, d):
    s = shares(spark, d)
    s = s.crossJoin(s.agg(F.min("y").alias("lo"), F.max("y").alias("hi")))  # one row
    g = s.groupBy("k").agg(F.avg(F.when(F.col("y") <= F.col("lo") + 1, F.col("share"))).alias("early"), F.avg(F.when(F.col("y") >= F.col("hi") - 1, F.col("share"))).alias("late"))
    known = F.col("early").isNotNull() & F.col("late").isNotNull()
    return g.select("k", F.when(~known, "unknown").when(F.col("late") > F.col("early") * 1.05, "rising").when(F.col("late") < F.col("early") * 0.95, "falling").otherwise("steady").alias("momentum"))


@query(f"""WITH n AS ({_MONTHLY}), b AS (SELECT max(m) AS hi FROM n) SELECT k, min(m) FILTER (WHERE n >= 3) AS first_month, round(avg(n) FILTER (WHERE m > hi - 3) / nullif(avg(n) FILTER (WHERE m BETWEEN hi - 11 AND hi - 3), 0), 4) AS accel FROM n, b GROUP BY k""")
def novelty_accel(spark, d):
    n = monthly(spark, d)
    n = n.crossJoin(n.agg(F.max("m").alias("hi")))  # one row
    mean = lambda c: F.avg(F.when(c, F.col("n")))
    m, hi = F.col("m"), F.col("hi")
    return n.groupBy("k").agg(F.min(F.when(F.col("n") >= 3, m)).alias("first_month"), F.round(ratio(mean(m > hi - 3), mean(m.between(hi - 11, hi - 3))), 4).alias("accel"))


@query("""WITH e AS (SELECT user_id, event_type, date_trunc('week', ts)::DATE AS wk FROM events), lim AS (SELECT min(wk) AS lo, max(wk) AS hi FROM e), panel AS (SELECT user_id FROM e, lim GROUP BY user_id HAVING bool_or(wk = lo) AND bool_or(wk = hi))
SELECT event_type, wk AS week, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY wk), 6)::DOUBLE AS share FROM e WHERE user_id IN (SELECT user_id FROM panel) GROUP BY event_type, wk""")
def fixed_panel_share(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", week_start("ts").alias("week"))
    lim = e.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))  # one row
    panel = e.crossJoin(lim).groupBy("user_id").agg(F.bool_or(F.col("week") == F.col("lo")).alias("a"), F.bool_or(F.col("week") == F.col("hi")).alias("b")).where("a AND b").select("user_id")
    n = e.join(panel, "user_id", "left_semi").groupBy("event_type", "week").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("week")), 6))


@query("""WITH w AS (SELECT event_type, date_trunc('week', ts)::DATE AS wk, count(*) AS n FROM events GROUP BY ALL), hi AS (SELECT max(wk) AS h FROM w)
SELECT event_type, max(n) FILTER (WHERE wk = h) AS now, quantile_cont(n, 0.5) FILTER (WHERE wk < h AND wk >= h - 28) AS base, round(max(n) FILTER (WHERE wk = h) / nullif(quantile_cont(n, 0.5) FILTER (WHERE wk < h AND wk >= h - 28), 0), 3) AS r FROM w, hi GROUP BY event_type""")
def week_vs_median4(spark, d):
    w = t(spark, d, "events").groupBy("event_type", week_start("ts").alias("wk")).agg(F.count("*").alias("n"))
    w = w.crossJoin(w.agg(F.max("wk").alias("h")))  # one row
    prior = (F.col("wk") < F.col("h")) & (F.col("wk") >= F.date_sub("h", 28))
    g = w.groupBy("event_type").agg(F.max(F.when(F.col("wk") == F.col("h"), F.col("n"))).alias("now"), F.percentile(F.when(prior, F.col("n")), 0.5).alias("base"))
    return g.withColumn("r", F.round(ratio("now", "base"), 3))


@query("""WITH w AS (SELECT user_id, (epoch(date_trunc('day', ts)) / 86400)::BIGINT AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL), s AS (SELECT user_id, unnest(generate_series(min(day), max(day))) AS day FROM w GROUP BY user_id)
SELECT s.user_id, s.day, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN w ON w.user_id = s.user_id AND w.day = s.day""")
def zero_filled_days(spark, d):
    w = t(spark, d, "events").where("event_type = 'error'").groupBy("user_id", F.datediff("ts", F.lit("1970-01-01")).cast("long").alias("day")).agg(F.count("*").alias("n"))
    return S.zero_filled(w, ["user_id"], "day", "n")


@query("""WITH y AS (SELECT p_brand AS k, CASE WHEN l_returnflag = 'N' THEN 'market' ELSE 'science' END AS tier, (year(l_shipdate) * 12 + month(l_shipdate) - 1)::BIGINT AS m, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
o AS (SELECT k, tier, min(m) FILTER (WHERE run >= greatest(3, total * 0.1)) AS onset FROM (SELECT *, sum(n) OVER (PARTITION BY k, tier ORDER BY m) AS run, sum(n) OVER (PARTITION BY k, tier) AS total FROM y) GROUP BY k, tier)
SELECT k, max(onset) FILTER (WHERE tier = 'market') - max(onset) FILTER (WHERE tier = 'science') AS lead_months FROM o GROUP BY k""")
def lead_time_two_tiers(spark, d):
    li = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = li.groupBy(F.col("p_brand").alias("k"), F.when(F.col("l_returnflag") == "N", "market").otherwise("science").alias("tier"), month_int("l_shipdate").alias("m")).agg(F.count("*").alias("n"))
    o = S.onset(n, ["k", "tier"], "m", "n").groupBy("k").pivot("tier", ["market", "science"]).agg(F.max("onset"))
    return o.select("k", (F.col("market") - F.col("science")).alias("lead_months"))


@query("""SELECT p_brand, l_suppkey, n FROM (SELECT p_brand, l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, l_suppkey) <= 5""")
def top_applicants(spark, d):
    n = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.count_distinct("l_orderkey").alias("n"))
    return R.first_per_key(n, ["p_brand"], [F.desc("n"), F.col("l_suppkey")], 5)


@query("""SELECT l_returnflag, quantile_disc(year(l_shipdate)::INT, 0.5) AS median_year FROM lineitem GROUP BY ALL""")
def weighted_median_year(spark, d):
    n = t(spark, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))
    w = W.partitionBy("l_returnflag")
    half = n.withColumns({"run": F.sum("n").over(w.orderBy("y")), "total": F.sum("n").over(w)})
    return half.groupBy("l_returnflag").agg(F.min(F.when(F.col("run") * 2 >= F.col("total"), F.col("y"))).alias("median_year"))


@query("""SELECT p_brand, p_partkey, n, run FROM (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY n DESC, p_partkey)::BIGINT AS run, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_partkey) AS i FROM (SELECT p_brand, p_partkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL))
QUALIFY i <= 25 AND coalesce(max(CASE WHEN run >= 120 AND i >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""")
def accumulate_until_dense(spark, d):
    n = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_partkey").agg(F.count("*").alias("n"))
    w = W.partitionBy("p_brand").orderBy(F.desc("n"), "p_partkey")
    r = n.withColumns({"run": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)), "i": F.row_number().over(w)})
    full = F.max(F.when((F.col("run") >= 120) & (F.col("i") >= 3), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    return r.withColumn("full", F.coalesce(full, F.lit(0))).where("i <= 25 AND full = 0").select("p_brand", "p_partkey", "n", "run")


@query("""SELECT y, age, round(count(*) / max(size), 6)::DOUBLE AS share FROM (SELECT year(o_orderdate)::INT AS y, datediff('day', o_orderdate, max(l_shipdate)) AS life, count(*) OVER (PARTITION BY year(o_orderdate)) AS size FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate), (SELECT unnest([30, 365, 1000])::INT AS age) WHERE life >= age GROUP BY y, age""")
def survival_share(spark, d):
    ships = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    o = t(spark, d, "orders").join(ships, "o_orderkey").select(F.year("o_orderdate").alias("y"), F.datediff("last", "o_orderdate").alias("life"))
    aged = o.withColumn("age", F.explode(F.array(F.lit(30), F.lit(365), F.lit(1000))))
    return aged.groupBy("y", "age").agg(F.round(F.count_if(F.col("life") >= F.col("age")) / F.count("*"), 6).alias("share")).where("share > 0")


@query("""SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN total >= 30 THEN round(10000.0 * n / total, 1) END AS per10k FROM (SELECT l_returnflag, l_shipdate, n, sum(n) OVER (PARTITION BY l_shipdate) AS total FROM (SELECT l_returnflag, date_trunc('month', l_shipdate) AS l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL))""")
def per_10k_share(spark, d):
    n = t(spark, d, "lineitem").groupBy("l_returnflag", month_key("l_shipdate").alias("month")).agg(F.count("*").alias("n"))
    n = n.withColumn("total", F.sum("n").over(W.partitionBy("month")))
    return n.select("l_returnflag", "month", per_10k("n", "total").alias("per10k"))


@query("""WITH x AS (SELECT ln(year(o_orderdate) - 1990) AS a, ln(sum(o_totalprice)) AS b FROM orders GROUP BY year(o_orderdate)) SELECT count(*) AS n, round(regr_intercept(b, a), 4) AS intercept, round(regr_slope(b, a), 4) AS slope, round(corr(a, b), 4) AS r FROM x""")
def log_log_fit(spark, d):
    x = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.log(F.sum("o_totalprice")).alias("b")).withColumn("a", F.log(F.col("y") - 1990))
    return x.agg(F.count("*").alias("n"), F.round(F.regr_intercept("b", "a"), 4).alias("intercept"), F.round(F.regr_slope("b", "a"), 4).alias("slope"), F.round(F.corr("a", "b"), 4).alias("r"))


@query("""WITH s AS (SELECT c_nationkey AS k, rank() OVER (ORDER BY sum(c_acctbal)) AS a, rank() OVER (ORDER BY count(*)) + (count(*) OVER (PARTITION BY count(*)) - 1) / 2.0 AS b FROM customer GROUP BY c_nationkey) SELECT round(corr(a, b), 4) AS rho FROM s""")
def spearman(spark, d):
    g = t(spark, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("v"), F.count("*").alias("n"))
    # ranks over 25 nations at most; ties share the middle rank
    r = g.withColumns({"a": F.rank().over(W.orderBy("v")), "b": F.rank().over(W.orderBy("n")) + (F.count("*").over(W.partitionBy("n")) - 1) / 2})
    return r.agg(F.round(F.corr(F.col("a").cast("double"), F.col("b")), 4).alias("rho"))
