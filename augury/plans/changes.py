"""Changes to tables: updates, purges, derived dimensions, exploded shards, deltas, work still to do, slow jobs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.text import company_key

from .catalog import query, t


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'archived' WHEN o_orderdate < '1995-01-01' AND o_orderstatus = 'O' THEN 'expired' ELSE o_orderstatus END AS status, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS overlaps FROM orders""")
def update_from_join(spark, d):
    """UPDATE by key, UPDATE by predicate and UPDATE ... FROM as one rewrite of the table."""
    o, keys = t(spark, d, "orders"), t(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey"), F.lit("archived").alias("new"))
    hit = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    x = o.join(keys, "o_orderkey", "left").join(hit, "o_orderkey", "left")
    old = (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "O")
    return x.select("o_orderkey", F.coalesce("new", F.when(old, "expired").otherwise(F.col("o_orderstatus"))).alias("status"), F.coalesce("hit", F.lit(False)).alias("overlaps"))


@query("""WITH b AS (SELECT max(ts) - INTERVAL 7 DAY AS cut FROM events) SELECT event_id, CASE WHEN ts < cut - INTERVAL 7 DAY AND event_type <> 'purchase' THEN NULL ELSE props END AS props FROM events, b WHERE ts >= cut - INTERVAL 14 DAY""")
def purge_with_retention(spark, d):
    """Rows beyond 21 days go; the payload of those beyond 14 is emptied unless it must be kept."""
    e = t(spark, d, "events")
    e = e.crossJoin(F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 7 DAY")).alias("cut"))))  # one row
    e = e.where("ts >= cut - INTERVAL 14 DAY")
    return e.select("event_id", F.when(F.expr("ts < cut - INTERVAL 7 DAY AND event_type <> 'purchase'"), F.lit(None)).otherwise(F.col("props")).alias("props"))


@query("""SELECT lower(c_name) AS key, min(c_custkey) AS head, count(*) AS members FROM customer GROUP BY 1""")
def normalised_dimension(spark, d):
    """Names to keys once, as a table that later joins read."""
    c = t(spark, d, "customer").select("c_custkey", company_key(F.concat("c_name", F.lit(" GmbH"))).alias("k"), "c_name")
    return c.groupBy(F.lower(F.regexp_replace("k", " ", "#")).alias("key")).agg(F.min("c_custkey").alias("head"), F.count("*").alias("members"))


@query("""SELECT l_orderkey AS pub, l_partkey AS cls, l_returnflag = 'R' AS inventive FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def exploded_shards(spark, d):
    """Shards with parallel arrays, cut to a set of keys before the arrays are taken apart."""
    shards = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pub")).agg(F.collect_list(F.struct("l_partkey", F.col("l_returnflag").alias("f"))).alias("xs"))
    shards = shards.select("pub", F.col("xs.l_partkey").alias("cls"), F.transform("xs.f", lambda f: f == "R").alias("inventive"))
    keys = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pub"))
    return shards.join(keys, "pub", "left_semi").select("pub", F.inline(F.arrays_zip("cls", "inventive")))


@query("""WITH n AS (SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders), e AS (SELECT a.k AS src, b.k AS dst FROM n a JOIN n b ON a.c = b.c AND a.i = b.i + 1)
SELECT e.src, e.dst, year(o_orderdate)::INT AS y, (SELECT string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FROM lineitem WHERE l_orderkey = e.src) AS classes FROM e JOIN orders ON o_orderkey = e.src WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders)""")
def delta_edges_and_nodes(spark, d):
    """Edges of the keys that are new since a stamp, with their year and classes."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = o.withColumn("dst", F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    new = o.crossJoin(F.broadcast(o.agg((F.max("o_orderdate") - F.expr("INTERVAL 365 DAY")).alias("stamp")))).where("o_orderdate >= stamp AND dst IS NOT NULL")
    classes = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("classes"))
    return new.join(classes, "o_orderkey", "left").select(F.col("o_orderkey").alias("src"), "dst", F.year("o_orderdate").alias("y"), "classes")


@query("""SELECT part, CASE WHEN done IS NULL THEN 'new' WHEN version < 2 THEN 'redo' ELSE 'done' END AS state, n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS part, count(*) AS n, CASE WHEN year(o_orderdate) < 1998 THEN 1 END AS done, CASE WHEN year(o_orderdate) % 2 = 0 THEN 2 ELSE 1 END AS version FROM orders GROUP BY ALL)""")
def parts_to_do(spark, d):
    """Parts of a source against what has been done to them, by version."""
    parts = t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("part")).agg(F.count("*").alias("n"))
    done = parts.where("part < '1998'").select("part", F.when(F.substring("part", 1, 4).cast("int") % 2 == 0, 2).otherwise(1).alias("version"))
    return parts.join(done, "part", "left").select("part", F.when(F.col("version").isNull(), "new").when(F.col("version") < 2, "redo").otherwise("done").alias("state"), "n")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND doc_id >= 20) WHERE i <= 3""")
def unprocessed_capped(spark, d):
    """Rows no label has marked yet, from an id on, a few of each source: counted in salted parts first."""
    rows = t(spark, d, "documents").where("doc_id >= 20").select("source", "doc_id").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    for key in (["source", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["source"]):  # a part keeps its own three before a source does
        rows = rows.withColumn("i", F.row_number().over(W.partitionBy(*key).orderBy("doc_id"))).where("i <= 3").drop("i")
    return rows.select("source", "doc_id")


@query("""WITH h AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'draft' ELSE 'live' END AS status FROM customer WHERE c_custkey < 100), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'gone' WHEN c_custkey % 5 = 0 THEN 'draft' ELSE 'live' END AS status FROM customer)
SELECT n.k, CASE WHEN h.k IS NULL THEN 'pull' ELSE 'recheck' END AS action, n.status FROM n LEFT JOIN h USING (k) WHERE (h.k IS NULL AND n.status <> 'gone') OR h.status IS DISTINCT FROM n.status AND h.k IS NOT NULL""")
def refresh_held(spark, d):
    """What is newer than the held rows is pulled; held rows whose status moved are named."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    base = F.when(F.col("k") % 5 == 0, "draft").otherwise("live")
    held = c.where("k < 100").withColumn("was", base)
    now = c.withColumn("status", F.when(F.col("k") % 7 == 0, "gone").otherwise(base)).join(held, "k", "left")
    return now.where("(was IS NULL AND status <> 'gone') OR was <> status").select("k", F.when(F.col("was").isNull(), "pull").otherwise("recheck").alias("action"), "status")


@query("""WITH p AS (SELECT event_id, user_id, event_type AS job, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events), m AS (SELECT job, quantile_cont(epoch(done) - epoch(ts), 0.5) AS med FROM p WHERE done IS NOT NULL GROUP BY job), now AS (SELECT max(ts) + INTERVAL 1 HOUR AS now FROM events)
SELECT event_id, p.job, round((epoch(now) - epoch(ts)) / 3600, 4) AS hours, epoch(now) - epoch(ts) > 2 * med AND epoch(now) - epoch(ts) - med > 600 AS slow, epoch(now) - epoch(ts) > 86400 AS hanging FROM p JOIN m USING (job), now WHERE done IS NULL""")
def slow_jobs(spark, d):
    """Open jobs against their own median (twice, and ten minutes over it) and a hard limit."""
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    e = t(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("job"), secs("ts").alias("at"))
    p = e.withColumn("done", F.lead("at").over(W.partitionBy("user_id").orderBy("at", "event_id")))
    m = p.where("done IS NOT NULL").groupBy("job").agg(F.percentile(F.col("done") - F.col("at"), 0.5).alias("med"))
    x = p.where("done IS NULL").join(F.broadcast(m), "job").crossJoin(F.broadcast(e.agg((F.max("at") + 3600).alias("now"))))  # jobs; one row
    run = F.col("now") - F.col("at")
    return x.select("event_id", "job", F.round(run / 3600, 4).alias("hours"), ((run > F.col("med") * 2) & (run - F.col("med") > 600)).alias("slow"), (run > 86400).alias("hanging"))
