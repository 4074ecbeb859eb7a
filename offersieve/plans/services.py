"""Queries of the service operators on the driver tables, each with its SQL. Orders stand for a log of preference
revisions, events for service events (type `error` a failure), customers for users."""

from __future__ import annotations

from pyspark.sql import functions as F

from offersieve.functions import text as X
from offersieve.operators import service as S
from offersieve.plans.offers import _read

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def prefs_latest(spark, sf_dir):
    return S.latest(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-15 03:00:00') WHERE r = 1")
def prefs_asof_midnight(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(866390400))  # 1997-06-15 12:00 UTC
    return S.as_of_midnight(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate", now, "America/Sao_Paulo")


@query("SELECT o_custkey, o_orderkey, r AS no FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def prefs_history(spark, sf_dir):
    return S.history(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 3).select("o_custkey", "o_orderkey", "no")


@query("SELECT count(*) AS changed FROM (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL OUTER JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey) WHERE a.k IS DISTINCT FROM b.k")
def prefs_diff(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    side = lambda s, k: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.max("o_orderkey").alias(k))
    return side("F", "a").join(side("O", "b"), "o_custkey", "full_outer").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS tokens, greatest(0, 3000 - count(*)) AS remaining FROM events GROUP BY event_type")
def budget_status(spark, sf_dir):
    out = _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("tokens"))
    return out.withColumn("remaining", F.greatest(F.lit(0), 3000 - F.col("n")))


@query("SELECT user_id, event_id, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, isle ORDER BY event_id)::BIGINT AS run FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS isle FROM (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events))")
def failure_runs(spark, sf_dir):
    return S.failure_runs(_read(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error", "event_id")


@query("SELECT event_id, least(300, 5 * power(2, least(event_id % 10, 6)))::INTEGER AS delay FROM events")
def retry_backoff(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", S.backoff((F.col("event_id") % 10).cast("int")).alias("delay"))


@query("SELECT event_id, user_id FROM events JOIN customer ON user_id = c_custkey WHERE event_type <> 'error' AND c_acctbal > 0 ORDER BY ts, event_id LIMIT 100")
def outbox_due_topk(spark, sf_dir):
    active = _read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return _read(spark, sf_dir, "events").filter("event_type <> 'error'").join(active, "user_id").orderBy("ts", "event_id").limit(100).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def retention_survivors(spark, sf_dir):
    return S.survivors(_read(spark, sf_dir, "events"), "user_id", "event_id", 20).select("event_id", "user_id")


@query("SELECT count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed, min(CASE WHEN event_type <> 'error' THEN event_id END) AS oldest FROM events")
def outbox_health(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return _read(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(bad).alias("failed"), F.min(F.when(~bad, F.col("event_id"))).alias("oldest"))


@query("SELECT c_custkey, coalesce(CASE WHEN n_regionkey = 1 THEN 'pt-BR' END, 'en') AS locale FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def resolved_users(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") == 1, F.lit("pt-BR")).alias("l"))
    return _read(spark, sf_dir, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("l", F.lit("en")).alias("locale"))


@query("SELECT p_partkey, count(l_partkey) AS refs FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def media_refcounts(spark, sf_dir):
    refs = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("refs"))
    return _read(spark, sf_dir, "part").select("p_partkey").join(refs, "p_partkey", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))


@query("SELECT p_partkey, ceil(row_number() OVER (ORDER BY p_partkey) / 5.0)::BIGINT AS page FROM part WHERE p_brand = 'Brand#1'")
def paged_preferences(spark, sf_dir):
    from pyspark.sql.window import Window

    mine = _read(spark, sf_dir, "part").filter("p_brand = 'Brand#1'")
    return mine.select("p_partkey", F.ceil(F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) / 5).alias("page"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_discount::DECIMAL(10,2) * 100)::INTEGER END AS percent FROM lineitem")
def discount_display(spark, sf_dir):
    p = F.lit(1).cast("decimal(10,2)")
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.discount_percent(p - F.col("l_discount").cast("decimal(10,2)"), p).alias("percent"))


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS sec FROM events)),
f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS admitted, []::DOUBLE[] AS log FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, i, event_id, len(log) < 2, CASE WHEN len(log) < 2 THEN list_append(log, sec) ELSE log END
  FROM (SELECT e.user_id, e.i, e.event_id::BIGINT AS event_id, e.sec, list_filter(f.log, lambda t: t > e.sec - 86400) AS log FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id::BIGINT AS key, event_id AS seq, admitted FROM f WHERE i > 0""")
def rate_limit_admitted(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return S.admitted(e, "user_id", "event_id", "at", ((86400.0, 2),))
