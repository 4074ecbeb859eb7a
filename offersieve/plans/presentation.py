"""Queries of presentation, tenancy and queues on the driver tables, each with its SQL. Customers stand for users, orders
for dated records of theirs, events for service events, pages for offers with links."""

from __future__ import annotations

from pyspark.sql import functions as F

from offersieve.functions import present as V
from offersieve.operators import tenancy as T
from offersieve.plans.offers import PRICES, _literals, _q, _read, _values, sql_price

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}]+"
_LINE = lambda t: f"trim(regexp_replace({t}, {_q(_SPACE)}, ' ', 'g'))"
_BARE = lambda t: f"regexp_replace({t}, '[\\x00-\\x1f\\x7f]', '', 'g')"
FIELDS = ["plain", " \x07 ", "see https://x.test", "a <b>bold</b> word", "fish &amp; chips", "/start now", "say /help me", "a/help", "x" * 301, "tab\tand\nline"]
REASONS = ["Fits. And more.", "no end", "v1.5 fits! yes", "", "x" * 300, "a  b\n c?"]
NOW = "TIMESTAMP '1997-06-15 12:00:00'"


def _chr(x: str) -> str:
    """A literal that holds control characters."""
    return "'" + x.replace("'", "''") + "'"


@query(f"WITH a AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT * FROM (VALUES {', '.join(f'({-1 - i}, {_chr(v)})' for i, v in enumerate(FIELDS))})), p AS (SELECT id, text, {_LINE(_BARE('text'))} AS p FROM a) SELECT id, length(p)::INTEGER AS n, CASE WHEN text IS NULL THEN NULL WHEN p = '' OR length(p) > 300 THEN 'empty_or_oversized' WHEN regexp_matches(p, {_q(V.MARKUP)}) THEN 'url_or_markup' WHEN regexp_matches(p, {_q(V.COMMAND)}) THEN 'command' END AS fault FROM p")
def plain_fields(spark, sf_dir):
    a = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    a = a.unionAll(_literals(spark, FIELDS).select((-1 - F.col("id")).alias("id"), "text"))
    return a.select("id", F.length(V.plain(F.col("text"))).alias("n"), V.plain_fault(F.col("text"), 300).alias("fault"))


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"WITH a AS (SELECT doc_id, coalesce(text, '') AS text, {_LINE('''coalesce(text, '')''')} AS x FROM documents), c AS (SELECT *, CASE WHEN length(x) > 700 THEN rtrim(left(x, 699)) || '…' ELSE x END AS y FROM a) SELECT doc_id, {_ESCAPED.format('y')} AS card, greatest(1, ceil(length(text) / 4096.0))::INTEGER AS n_chunks, length(CASE WHEN text = '' THEN 'Promotion' ELSE substr(text, 4096 * (greatest(1, ceil(length(text) / 4096.0))::INTEGER - 1) + 1) END)::INTEGER AS last_chunk FROM c")
def message_chunks(spark, sf_dir):
    parts = V.chunks(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", V.clean(F.col("text")).alias("card"), F.size(parts).alias("n_chunks"), F.length(F.element_at(parts, -1)).alias("last_chunk"))


@query(f"WITH a AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT -1 - id, text FROM {_values(REASONS)}), x AS (SELECT id, {_LINE('text')} AS x FROM a), f AS (SELECT id, trim(coalesce(nullif(regexp_extract(x, '^(.*?[.!?])(?:\\s|$)', 1), ''), x)) AS f FROM x) SELECT id, nullif(CASE WHEN length(f) > 240 THEN rtrim(left(f, 237)) || '...' ELSE f END, '') AS reason FROM f")
def shaped_reasons(spark, sf_dir):
    a = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return a.unionAll(_literals(spark, REASONS).select((-1 - F.col("id")).alias("id"), "text")).select("id", V.shaped_reason(F.col("text")).alias("reason"))


@query(f"SELECT id, CASE WHEN regexp_matches(text, {_q(V.SHOWN_PRICE)}) AND {sql_price('text')} > 0 THEN {sql_price('text')}::DOUBLE END AS price FROM (SELECT * FROM {_values(PRICES)} UNION ALL SELECT p_partkey + 1000, p_retailprice::VARCHAR FROM part)")
def shown_prices(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).alias("id"), F.col("p_retailprice").cast("string").alias("text"))
    return _literals(spark, PRICES).unionAll(part).select("id", V.shown_price(F.col("text")).cast("double").alias("price"))


_HREFS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
_VALID = f"list_filter(list_transform(list_concat([url], {_HREFS}), lambda u: trim({_BARE('u')})), lambda u: regexp_matches(u, '(?i)^https?://[^\\s/?#@]+(?:[/?#]\\S*)?$'))"


@query(f"WITH v AS (SELECT page_id, url, {_VALID} AS v FROM pages), d AS (SELECT page_id, url, list_filter(v, lambda u, i: list_position(v, u) = i)[1:5] AS l FROM v) SELECT page_id, len(l)::INTEGER AS n_links, array_to_string(list_transform(l, lambda u, i: 'link_' || i || '=' || u), ' ') AS links, sha256('{{\"link_candidates\":[' || array_to_string(list_transform(l, lambda u, i: '{{\"id\":\"link_' || i || '\",\"url\":' || to_json(u)::VARCHAR || '}}'), ',') || '],\"price\":null,\"text\":' || to_json(url)::VARCHAR || ',\"title\":\"' || page_id || '\"}}') AS digest FROM d")
def link_candidates(spark, sf_dir):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    links = V.link_candidates(F.array("url"), hrefs)
    shown = F.array_join(F.transform(links, lambda x: F.concat_ws("=", x["id"], x["url"])), " ")
    return _read(spark, sf_dir, "pages").select("page_id", F.size(links).alias("n_links"), shown.alias("links"), V.offer_digest(F.col("page_id").cast("string"), F.col("url"), F.lit(None).cast("decimal(18,2)"), links).alias("digest"))


DETAILS = ["https://shop.example.org/d/abc?utm_source=x", "https://shop.example.org/d/", "http://shop.example.org/d/abc", "https://shop.example.org:443/d/abc/", "https://shop.example.org:80/d/abc", "https://me@shop.example.org/d/abc", "https://other.example.org/d/abc"]
_SURE = ", ".join(f"({i}, {_q(u)}, {_q(w) if w else 'NULL'})" for i, (u, w) in enumerate(zip(DETAILS, ["https://shop.example.org/d/abc", None, None, "https://shop.example.org:443/d/abc", None, None, None], strict=True)))


@query(f"SELECT id::BIGINT AS id, want AS detail FROM (VALUES {_SURE}) AS v(id, url, want) UNION ALL SELECT page_id + 1000, NULL FROM pages")
def detail_urls(spark, sf_dir):
    """No page of the driver table is of this host, so all of them are refused."""
    pages = _read(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), F.col("url").alias("text"))
    return _literals(spark, DETAILS).unionAll(pages).select("id", V.detail_url(F.col("text"), "shop.example.org").alias("detail"))


IMAGES = ["FFD8FF00", "89504E470D0A1A0A00", "524946460000000057454250" + "00" * 8, "524946460000000057454250" + "00" * 8 + "414E494D", "524946460000000057454250", "47494638", ""]


@query("SELECT id::BIGINT AS id, kind FROM (VALUES (0, 'image/jpeg'), (1, 'image/png'), (2, 'image/webp'), (3, NULL), (4, NULL), (5, NULL), (6, NULL)) AS v(id, kind) UNION ALL SELECT page_id + 1000, NULL FROM pages")
def image_types(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), F.col("html").cast("binary").alias("data"))
    return _literals(spark, IMAGES).select("id", F.unhex("text").alias("data")).unionAll(pages).select("id", V.image_type(F.col("data")).alias("kind"))


_SHARE = "(('0x' || left(md5(event_id::VARCHAR), 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"WITH e AS (SELECT event_id, value, event_id % 7 AS failures, {_SHARE} AS share FROM events), b AS (SELECT *, least(300.0, 30.0 * 2 ** least(failures, 4)) AS base FROM e) SELECT event_id, round(CASE WHEN event_id % 5 = 0 AND value > 0 THEN value WHEN event_id % 3 = 0 THEN 12.5 ELSE least(300.0, base + share * least(30.0, base * 0.25)) END, 6) AS delay FROM b")
def rate_limit_delays(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    share = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    header, metadata = F.when(F.col("event_id") % 5 == 0, F.col("value")), F.when((F.col("event_id") % 3 == 0) & ~((F.col("event_id") % 5 == 0) & (F.col("value") > 0)), V.duration_seconds(F.lit("12.5s")))
    return e.select("event_id", F.round(V.rate_limit_delay(header, metadata, F.col("event_id") % 7, share), 6).alias("delay"))


@query("SELECT event_id, CASE WHEN event_type = 'view' AND value < 50 THEN 'retry' ELSE 'discard' END AS decision, CASE WHEN event_type = 'error' THEN 'llm_daily_budget_exhausted' WHEN event_type = 'view' AND value < 50 THEN 'llm_retry_queued' WHEN event_type = 'view' THEN 'llm_retry_queue_full' ELSE left('llm_permanent_error:' || event_type, 500) END AS reason, CASE WHEN starts_with(event_type, 'preference_') THEN 'preference' WHEN event_type = 'evaluation' THEN 'evaluation' ELSE 'presentation' END AS stage FROM events")
def error_decisions(spark, sf_dir):
    kind = F.col("event_type")
    outcome = F.when(kind == "error", F.lit("daily_budget")).when(kind == "view", F.lit("retryable")).otherwise(F.lit("permanent"))
    decision, reason = V.error_decision(outcome, F.col("value") < 50, kind)
    return T.decisions(_read(spark, sf_dir, "events").select("event_id", decision.alias("decision"), reason.alias("reason"), V.request_stage(kind).alias("stage")), "reason")


@query("SELECT c_custkey, left(sha256('user' || chr(0) || c_name), 16) AS short_id, left(sha256(c_mktsegment || chr(0) || c_custkey), 32) AS entry_id FROM customer")
def short_ids(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    return c.select("c_custkey", V.short_id(16, F.lit("user"), F.col("c_name")).alias("short_id"), V.short_id(32, F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("entry_id"))


@query("WITH o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), f AS (SELECT c_custkey, true AS flag FROM customer WHERE c_acctbal < 1000) SELECT c_custkey, coalesce(flag, false) AS exceptional, coalesce(n, 0) = 0 AND NOT coalesce(flag, false) AS idle FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN f USING (c_custkey)")
def idle_users(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    interests = _read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    flags = c.filter("c_acctbal < 1000").select("c_custkey", F.lit(True).alias("exceptional"))
    return T.with_flag(c, flags, "c_custkey", "exceptional").join(interests, "c_custkey", "left").select("c_custkey", "exceptional", T.idle(F.col("n"), F.col("exceptional")).alias("idle"))


@query("SELECT row_number() OVER (ORDER BY c_nationkey, lower(c_name), c_custkey)::INTEGER AS place, c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE' ORDER BY place LIMIT 100")
def dialogs_listed(spark, sf_dir):
    """The first hundred of a listing with one filter set and one not."""
    top = T.listed(_read(spark, sf_dir, "customer"), {"c_mktsegment": "FURNITURE", "c_nationkey": None}, "c_nationkey", "c_name", "c_custkey").limit(100)
    return top.agg(F.collect_list("c_custkey").alias("x")).select(F.posexplode("x").alias("at", "c_custkey")).select((F.col("at") + 1).alias("place"), "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 250")
def keyset_page(spark, sf_dir):
    return T.page_after(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 700, 250)


@query("SELECT c_custkey, round(coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey), c_acctbal), 2) AS c_acctbal FROM customer")
def carried_balances(spark, sf_dir):
    most = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return T.carried(_read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), most, "c_custkey", "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 1 DAY > {NOW}")
def invitations_open(spark, sf_dir):
    return _read(spark, sf_dir, "orders").filter(T.redeemable(F.col("o_orderdate").cast("timestamp"), F.col("o_orderstatus") == "F", F.expr(NOW))).select("o_orderkey")


@query(f"SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderkey = m AND o_orderdate + INTERVAL 10 MINUTE > {NOW}")
def confirmations_open(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    current = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return T.open_confirmations(o, current, "o_custkey", "o_orderkey", "at", F.expr(NOW)).select("o_custkey", "o_orderkey")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 1 HOUR")
def transient_survivors(spark, sf_dir):
    return T.transient_survivors(_read(spark, sf_dir, "events"), "ts", F.expr("TIMESTAMP '2024-01-02 12:00:00'")).select("event_id")


@query("SELECT user_id, count(DISTINCT event_id) AS n, max(event_id) + 1 AS next_offset FROM events GROUP BY user_id")
def update_offsets(spark, sf_dir):
    return T.offsets(_read(spark, sf_dir, "events"), "user_id", "event_id")


_WAITING = "(SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND event_id < 200)"


@query(f"WITH q AS {_WAITING}, n AS (SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events ANTI JOIN q USING (user_id) WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, event_id, greatest(5.0, least(3600.0, coalesce(value, 5.0)))::DOUBLE AS delay FROM n ORDER BY event_id LIMIT (SELECT greatest(0, 100 - count(*)) FROM q)")
def retries_admitted(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    queued = e.filter("event_type = 'purchase' AND event_id < 200").select("user_id").distinct()
    return T.admitted_retries(e.filter("event_type = 'error'").select("user_id", "event_id", "value"), queued, ["user_id"], ["event_id"], "value").select("user_id", "event_id", "delay")


@query("SELECT min(ts) FILTER (event_type = 'error') AS next_attempt, count(*) FILTER (event_type = 'error') AS depth, (SELECT count(*) FROM documents) AS corpus_size FROM events")
def queue_state(spark, sf_dir):
    e = _read(spark, sf_dir, "events").agg(F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("next_attempt"), F.count_if(F.col("event_type") == "error").alias("depth"))
    return e.join(F.broadcast(_read(spark, sf_dir, "documents").agg(F.count("*").alias("corpus_size"))))
