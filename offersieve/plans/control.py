"""Queries of preferences, admission, queues and feeds, each with its SQL where there is one. Orders stand for a log of
revisions, events for requests and queue entries, suppliers for chats; change lists and feed pages are literals."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offersieve.operators import admission, preferences
from offersieve.operators import service as S
from offersieve.plans.offers import _literals, _q, _read
from offersieve.sources import feed, messages

QUERIES: dict = {}
ORACLE: dict = {}

OPS = [(1, "add", "interest", "a"), (2, "remove", "interest", "b"), (3, "remove", "interest", "b"), (3, "remove", "alias", "c"), (4, "update", "hard_rule", "r"), (5, "remove", "interest", "r"), (6, "remove", "exclusion", "c"), (7, "remove", "alias", "c"), (7, "remove", "alias", "d"), *[(8, "add", "context", f"n{i}") for i in range(6)]]
CURRENT = [("b", "interest", True), ("c", "alias", False), ("r", "hard_rule", False)]
ENTRIES = [
    ("interest", {"name": "SSD", "importance": 80}), ("interest", {"name": "SSD", "importance": 101}), ("interest", {"name": "SSD", "importance": 1.5}), ("interest", {"importance": 1}),
    ("interest", {"name": "SSD", "constraints": {"min_price": "10", "max_price": "5"}}), ("alias", {"canonical": "SSD", "synonyms": ["ssd"]}), ("alias", {"canonical": "SSD", "synonyms": ["nvme"]}),
    ("hard_rule", {"rule_id": "a b", "priority": 1, "action": "deny", "any": ["x"]}), ("hard_rule", {"rule_id": "ab", "priority": 1, "action": "block", "any": ["x"]}),
    ("hard_rule", {"rule_id": "ab", "priority": 1, "action": "deny"}), ("hard_rule", {"rule_id": "ab", "priority": 2000000, "action": "deny", "any": ["x"]}), ("exclusion", {"terms": []}), ("context", {"fact": "x"}), ("other", {}),
]
ORIGIN, STORES = "https://shop.example", "/store/"
_CARD = '<a href="/d/{u}" data-deal-id="{i}">{t}</a><span class="deal-card-stamp">R$ {p}</span><b data-temperature-level="hot">{d}º</b><img class="deal-card-image" srcset="https://i/1 100w, https://i/2 200w"><a href="/store/x">Loja</a>'
_LIST = {"mainEntity": {"@type": "CollectionPage", "hasPart": [{"name": n, "url": u} for n, u in (("SSD", "/d/a"), ("", "/d/b"), ("Cabo", ""), ("Blog", "/blog/x"), ("Dois", "/d/c"), ("Sem", "/d/e"), ("Mouse", "/d/f"))]}}
FEED = f'<script id="feed-schema" type="application/ld+json">{json.dumps(_LIST)}</script>' + "".join(_CARD.format(u=u, i=i, t=t, p=p, d=d) for u, i, t, p, d in (("a", 1, "SSD", "1.299,90", 310), ("a", "", "SSD", "1.299,90", 310), ("c", 2, "Dois", "5", 1), ("c", 3, "Dois", "5", 1), ("f", 4, "Rato", "9", 2)))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _sql_rows(rows) -> str:
    one = lambda v: "NULL" if v is None else _q(v) if isinstance(v, str) else str(v).lower()
    return "(VALUES " + ", ".join(f"({', '.join(map(one, r))})" for r in rows) + ")"


@query("SELECT o_custkey, o_orderkey, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS parent FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def prefs_undo(spark, sf_dir):
    """The last revision and the one it came from; the limit of two a key is applied per task before the shuffle."""
    last = S.history(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 2).groupBy("o_custkey")
    return last.agg(F.max("o_orderkey").alias("o_orderkey"), F.coalesce(F.max(F.when(F.col("no") == 2, F.col("o_orderkey"))), F.lit(0)).alias("parent"))


@query(f"""WITH o(change_id, action, kind, entry_id) AS (SELECT * FROM {_sql_rows(OPS)}), c(entry_id, entry_kind, has_category) AS (SELECT * FROM {_sql_rows(CURRENT)}),
f AS (SELECT change_id, count(*) AS n, bool_or(kind = 'hard_rule' OR coalesce(entry_kind = 'hard_rule', false)) AS rules, sum((action = 'remove')::INTEGER) AS removed, bool_or(action = 'remove' AND coalesce(entry_kind = 'interest' AND has_category, false)) AS cat FROM o LEFT JOIN c USING (entry_id) GROUP BY change_id),
r AS (SELECT change_id::BIGINT AS change_id, CASE WHEN rules THEN 'hard_rule_change' WHEN n > 5 THEN 'more_than_five_entries' WHEN cat THEN 'category_deletion' WHEN removed > 1 THEN 'bulk_deletion' ELSE 'narrow_change' END AS reason FROM f)
SELECT change_id, reason <> 'narrow_change' AS needs_confirmation, reason FROM r""")
def confirmation_risk(spark, sf_dir):
    ops = spark.createDataFrame(OPS, "change_id long, action string, kind string, entry_id string")
    return preferences.risk(ops, spark.createDataFrame(CURRENT, "entry_id string, entry_kind string, has_category boolean"))


@query(None)
def entry_validation(spark, sf_dir):
    e = spark.createDataFrame([(i, k, json.dumps(d)) for i, (k, d) in enumerate(ENTRIES)], "id long, kind string, data string")
    return e.select("id", preferences.entry_problem(F.col("kind"), F.col("data")).alias("problem"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_limit_counts(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("user_id", "event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-3599999999, 0)).alias("n"))


@query(None)
def admission_fold(spark, sf_dir):
    """Events as requests of one project per user, ten a day; clicks count as preference requests, at most four."""
    e = _read(spark, sf_dir, "events").withColumns({"at": F.col("ts").cast("timestamp"), "stage": F.when(F.col("event_type") == "click", "preference").otherwise("evaluation")})
    return admission.admissions(e, "user_id", "event_id", "at", "stage", admission.Caps(10, 2, {"preference": 4, "evaluation": 8}))


@query(None)
def preference_fold(spark, sf_dir):
    """Orders as changes: of even keys an addition, of odd ones an update, always against revision key % 4."""
    o = _read(spark, sf_dir, "orders")
    op = F.struct(F.when(F.col("o_orderkey") % 2 == 0, "add").otherwise("update").alias("action"), F.concat(F.lit("e"), F.col("o_orderkey") % 3).alias("entry_id"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key")).alias("data"))
    log = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 4).alias("base_revision"), F.to_json(F.array(op)).alias("operations"))
    return preferences.folded(log)


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN least(300, greatest(5, value)) ELSE least(300, 5 * power(2, event_id % 9)) END AS delay FROM events")
def delivery_backoff(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("event_type") == "error", S.clamped(F.col("value"))).otherwise(S.backoff(F.col("event_id") % 9, power=60).cast("double")).alias("delay"))


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-02' THEN 'retry_expired' END AS outcome FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100)")
def retry_due_topk(spark, sf_dir):
    e = _read(spark, sf_dir, "events").filter("event_type = 'error'").orderBy("ts", "event_id").limit(100)
    return e.select("event_id", F.when(F.col("ts").cast("timestamp") < F.to_timestamp(F.lit("2024-01-02")), F.lit("retry_expired")).alias("outcome"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS r FROM conversations) WHERE r <= 50")
def command_log_cap(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").withColumn("at", F.struct("conv_id", "turn"))
    return S.survivors(c, "role", "at", 50).select("conv_id", "turn")


@query("SELECT coalesce(a.k, b.k) AS s_suppkey, CASE WHEN b.k IS NOT NULL THEN b.name ELSE a.name END AS name, coalesce(a.enabled, false) AS enabled FROM (SELECT s_suppkey AS k, s_name AS name, s_suppkey % 2 = 0 AS enabled FROM supplier WHERE s_suppkey % 3 > 0) a FULL OUTER JOIN (SELECT s_suppkey AS k, upper(s_name) AS name FROM supplier WHERE s_suppkey % 5 > 0) b ON a.k = b.k")
def upsert_dialogs(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier")
    have = s.filter("s_suppkey % 3 > 0").select("s_suppkey", F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("enabled"))
    return messages.upsert(have, s.filter("s_suppkey % 5 > 0").select("s_suppkey", F.upper("s_name").alias("name")), "s_suppkey", ["name"])


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, isle ORDER BY event_id) AS run, ok FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS isle FROM (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events))) WHERE NOT ok AND run = 3")
def alerts_raised(spark, sf_dir):
    """One alert per outage, at the third failure in a row."""
    return S.failure_runs(_read(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error", "event_id").filter("run = 3").select("user_id", "event_id")


@query("SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS title, len(list_distinct(regexp_extract_all(coalesce(text, ''), 'https?://[^ \\n\\t]+')))::BIGINT AS n_urls FROM conversations")
def message_offers(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    o = messages.offers(c, "conv_id", "turn", "text").withColumns({"conv_id": F.split("id", ":")[0].cast("long"), "turn": F.split("id", ":")[1].cast("long")})
    return o.select("conv_id", "turn", "title", F.size("urls").cast("long").alias("n_urls"))


@query(None)
def feed_offers(spark, sf_dir):
    pages = _literals(spark, [FEED]).select(F.col("id").alias("page_id"), F.col("text").alias("html"))
    return feed.offers(pages, ORIGIN, STORES).select(F.col("position").cast("long"), "title", "skip_reason")


@query("SELECT event_id FROM events e ANTI JOIN (SELECT l_orderkey FROM lineitem) d ON e.event_id = d.l_orderkey SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON e.user_id = c.c_custkey WHERE event_type <> 'error'")
def enqueued_deliveries(spark, sf_dir):
    """Offers to active users that were neither delivered nor queued before."""
    active = _read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    done = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id")).distinct()
    return S.enqueued(_read(spark, sf_dir, "events").filter("event_type <> 'error'"), active, done, "user_id", ["event_id"]).select("event_id")
