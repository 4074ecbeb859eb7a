"""The queue of replies on sinks that take batches twice, with its SQL: orders are replies to their customers, lines of orders
are attempts."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.operators import outbox as O
from offersieve.operators.lineage import _delete, shared_dir
from offersieve.plans.offers import _read

QUERIES: dict = {}
ORACLE: dict = {}

_ORDER = ["tried_at", "no", "part", "supplier", "quantity", "outcome"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies and attempts in two batches each, of which the second holds much of the first again and is itself taken twice."""
    root = f"{shared_dir(spark)}/offersieve-outbox-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, root)
    edit = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    asked = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reply_id"), F.col("o_custkey").alias("user_id"), F.when(edit, "edit").otherwise("send").alias("operation"), F.when(edit, F.col("o_orderkey") + 7).alias("target"))
    flags = F.concat("l_returnflag", "l_linestatus")
    outcome = F.when(flags == "RF", "sent").when(flags == "NF", "permanent").when(flags == "AF", "stale").otherwise("retry")
    tried = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("reply_id"), F.col("l_shipdate").alias("tried_at"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").alias("quantity"), outcome.alias("outcome"), F.concat_ws(":", "l_linenumber", "l_partkey", outcome).alias("error"))
    replies, attempts = O.BatchLog(spark, f"{root}/replies", asked.schema), O.BatchLog(spark, f"{root}/attempts", tried.schema)
    for log, rows, first, second in ((replies, asked, "operation = 'edit'", "operation = 'send' OR user_id % 2 = 0"), (attempts, tried, "outcome <> 'retry'", "outcome IN ('retry', 'sent')")):
        log.append(rows.filter(first), 0)
        log.append(rows.filter(second), 1)
        log.append(rows.filter(second), 1)
    return O.reply_state(replies.rows(["reply_id"], ["user_id"]), attempts.rows(["reply_id", *_ORDER], ["error"]), _ORDER)


_SQL = """WITH RECURSIVE a AS (SELECT DISTINCT l_orderkey AS reply_id, l_shipdate AS tried_at, l_linenumber AS no, l_partkey AS part, l_suppkey AS supplier, l_quantity AS quantity,
    CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'sent' WHEN 'NF' THEN 'permanent' WHEN 'AF' THEN 'stale' ELSE 'retry' END AS outcome FROM lineitem),
n AS (SELECT reply_id, outcome, no || ':' || part || ':' || outcome AS error, row_number() OVER (PARTITION BY reply_id ORDER BY tried_at, no, part, supplier, quantity, outcome) AS nth FROM a),
f AS (SELECT o_orderkey AS reply_id, o_custkey AS user_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'edit' ELSE 'send' END AS operation, 'open' AS status, 0::BIGINT AS attempts, NULL::VARCHAR AS last_error FROM orders
    UNION ALL SELECT f.reply_id, user_id, CASE WHEN outcome = 'stale' THEN 'send' ELSE operation END,
        CASE WHEN outcome = 'sent' THEN 'sent' WHEN outcome = 'permanent' OR (outcome = 'stale' AND operation = 'send') OR (outcome = 'retry' AND attempts >= 4) THEN 'dropped' ELSE 'open' END,
        attempts + 1, CASE WHEN outcome = 'sent' THEN last_error ELSE error END FROM f JOIN n ON n.reply_id = f.reply_id AND nth = attempts + 1 WHERE status = 'open'),
s AS (SELECT reply_id, user_id, arg_max(operation, attempts) AS operation, arg_max(status, attempts) AS status, max(attempts) AS attempts, max_by(struct_pack(e := last_error), attempts).e AS last_error FROM f GROUP BY reply_id, user_id)"""


@query(f"{_SQL} SELECT reply_id, user_id, operation, CASE WHEN operation = 'edit' THEN reply_id + 7 END AS target, status, attempts, last_error FROM s")
def reply_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has become of every reply."""
    return _state(spark, sf_dir)


@query(f"{_SQL} SELECT user_id, reply_id, operation, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reply_id) AS place FROM s WHERE status = 'open') WHERE place <= 20")
def replies_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's next replies in their order."""
    return O.next_replies(_state(spark, sf_dir)).select("user_id", "reply_id", "operation", F.col("place").cast("long").alias("place"))
