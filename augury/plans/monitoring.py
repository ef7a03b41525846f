"""Windowed monitoring of event streams: the batch twins of what ``augury.streaming`` runs continuously."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.functions.dates import epoch_bucket, epoch_seconds
from augury.operators import monitoring as M

from .catalog import query, t


def _events(spark, d):
    return t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT floor(epoch(time_bucket(INTERVAL 6 HOUR, ts)))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top FROM events GROUP BY ALL""")
def tumbling_buckets(spark, d):
    aggs = [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("top")]
    return M.buckets(_events(spark, d), "ts", "6 hours", ["event_type"], aggs).withColumn("start", epoch_seconds("start"))


@query("""SELECT floor(epoch(date_trunc('hour', ts)))::BIGINT AS start, max((props->>'$.k')::INT) AS top FROM events GROUP BY ALL""")
def tumbling_json_device(spark, d):
    e = _events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return M.buckets(e, "ts", "1 hour", [], [F.max("k").alias("top")]).withColumn("start", epoch_seconds("start"))


@query("""SELECT s AS start, count(*) AS n FROM (SELECT unnest([(floor(epoch(ts))::BIGINT // 43200) * 43200, (floor(epoch(ts))::BIGINT // 43200) * 43200 - 43200]) AS s, ts FROM events) GROUP BY s""")
def sliding_windows(spark, d):
    return M.buckets(_events(spark, d), "ts", "24 hours", [], [F.count("*").alias("n")], "12 hours").withColumn("start", epoch_seconds("start"))


@query("""SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_windows(spark, d):
    return M.sessions(_events(spark, d), "ts", "2 hours", ["user_id"], [F.count("*").alias("n")]).select("user_id", epoch_seconds("start").alias("start"), "n")


@query("""SELECT user_id, floor(epoch(ts))::BIGINT AS started, CASE WHEN nt = 'purchase' THEN floor(epoch(na))::BIGINT END AS ended FROM (SELECT *, lead(event_type) OVER w AS nt, lead(ts) OVER w AS na FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'signup'""")
def start_end_pairing(spark, d):
    p = M.pair_start_end(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase", "ts")
    return p.select("user_id", epoch_seconds("started").alias("started"), epoch_seconds("ended").alias("ended"))


@query("""SELECT event_id FROM (SELECT event_id, min((value > 20)::INT) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE m = 1 AND n = 3""")
def consecutive_condition(spark, d):
    return M.held_for(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("value") > 20, 3).where("held").select("event_id")


@query("""SELECT user_id, day, n, n - lag(n) OVER (PARTITION BY user_id ORDER BY day) AS delta, coalesce(n > 1.5 * lag(n) OVER (PARTITION BY user_id ORDER BY day), FALSE) AS rising FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)""")
def rising_counter(spark, d):
    from pyspark.sql import Window as W

    n = t(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    prev = F.lag("n").over(W.partitionBy("user_id").orderBy("day"))
    return n.withColumns({"delta": F.col("n") - prev, "rising": F.coalesce(F.col("n") > 1.5 * prev, F.lit(False))})


@query("""WITH r AS (SELECT user_id, ts, event_id, event_type = 'error' AS f, coalesce(lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS p FROM events), e AS (SELECT user_id, ts, f, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM r WHERE f <> p)
SELECT user_id, floor(epoch(ts))::BIGINT AS opened, floor(epoch(nx))::BIGINT AS resolved FROM e WHERE f""")
def alert_state(spark, d):
    a = M.alert_runs(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "ts")
    return a.select("user_id", epoch_seconds("opened").alias("opened"), epoch_seconds("resolved").alias("resolved"))


@query("""SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts > p + INTERVAL 6 HOUR""")
def ttl_dedup(spark, d):
    return M.first_within(_events(spark, d), ["user_id", "event_type"], "ts", "event_id", "6 HOURS").select("event_id")


@query("""SELECT user_id, floor(max(epoch(ts)))::BIGINT AS last_seen, count(*) FILTER (WHERE ts > m - INTERVAL 24 HOUR) AS n24, max(ts) < m - INTERVAL 12 HOUR AS stale FROM events, (SELECT max(ts) AS m FROM events) GROUP BY user_id, m""")
def freshness_watchdog(spark, d):
    e = _events(spark, d)
    e = e.crossJoin(e.agg(F.max("ts").alias("m")))  # one row
    g = e.groupBy("user_id", "m").agg(F.max("ts").alias("last"), F.count_if(F.col("ts") > F.col("m") - F.expr("INTERVAL 24 HOURS")).alias("n24"))
    return g.select("user_id", epoch_seconds("last").alias("last_seen"), "n24", (F.col("last") < F.col("m") - F.expr("INTERVAL 12 HOURS")).alias("stale"))


@query("""SELECT b, count(*) AS n, CASE WHEN count(*) < 20 THEN 'not checked' WHEN count(*) FILTER (WHERE event_type = 'error') > 0.25 * count(*) THEN 'alert' ELSE 'ok' END AS state FROM (SELECT (floor(epoch(ts))::BIGINT // 86400) * 86400 AS b, event_type FROM events) GROUP BY b""")
def tri_state_rule(spark, d):
    g = t(spark, d, "events").groupBy(epoch_bucket("ts", 86400).alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    return g.select("b", "n", F.when(F.col("n") < 20, "not checked").when(F.col("e") > 0.25 * F.col("n"), "alert").otherwise("ok").alias("state"))


@query("""SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_id > 100""")
def high_watermark_slice(spark, d):
    e = t(spark, d, "events").where("event_id > 100")
    top = t(spark, d, "events").agg(F.max("ts").alias("m"))  # one row
    return e.crossJoin(top).where(F.col("ts") >= F.col("m") - F.expr("INTERVAL 7 DAYS")).select("event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS worker, ts FROM events WHERE NOT (event_type = 'purchase' AND value > 95)), f AS (SELECT user_id, min(ts) AS done FROM events WHERE event_type = 'purchase' AND value > 95 GROUP BY 1),
c AS (SELECT e.* FROM e LEFT JOIN f USING (user_id) WHERE done IS NULL OR ts < done), g AS (SELECT user_id, min(ts) AS ts FROM c GROUP BY 1 UNION ALL SELECT g.user_id, (SELECT min(c.ts) FROM c WHERE c.user_id = g.user_id AND c.ts >= g.ts + INTERVAL 7 DAY) FROM g WHERE g.ts IS NOT NULL)
SELECT g.user_id, min(c.worker) AS worker, g.ts FROM g JOIN c ON c.user_id = g.user_id AND c.ts = g.ts GROUP BY g.user_id, g.ts""")
def lease_grants(spark, d):
    """Users as items, kinds of events as workers that claim them for a week; a large purchase ends an item."""
    from augury.operators import queue

    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return queue.grants(e.withColumnRenamed("event_type", "worker"), "user_id", "worker", "ts", (F.col("worker") == "purchase") & (F.col("value") > 95), 7 * 86400)


@query("""WITH a AS (SELECT o_custkey, date_diff('day', o_orderdate, DATE '1998-08-02') AS age, o_totalprice AS v FROM orders WHERE o_orderdate <= DATE '1998-08-02'), w AS (SELECT k.o_custkey, days, count(v) AS n, sum(v) AS total FROM (SELECT DISTINCT o_custkey FROM orders) k CROSS JOIN (SELECT unnest([30, 90, 180, 365, 1500]) AS days) LEFT JOIN a ON a.o_custkey = k.o_custkey AND age < days GROUP BY ALL)
SELECT o_custkey, days, n, round(total, 2)::DOUBLE AS total, n >= 5 AS enough FROM w QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n >= 5 DESC, CASE WHEN n >= 5 THEN days ELSE -days END) = 1""")
def widened_windows(spark, d):
    """Each customer's narrowest window of days with five orders, the widest where even that has fewer."""
    o = t(spark, d, "orders").select("o_custkey", F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date")).alias("age"), "o_totalprice")
    w = M.narrowest_window(o, ["o_custkey"], F.col("age"), [30, 90, 180, 365, 1500], 5, F.col("o_totalprice"))
    return w.withColumn("total", F.round(F.col("total").cast("double"), 2))
