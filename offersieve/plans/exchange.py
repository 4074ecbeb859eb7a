"""Queries of extraction checks, cards, item lists and the request ledger on the driver tables, each with its SQL. Parts
stand for offers (some made faulty by their key), line items for metered requests, events for changes and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from offersieve.operators import grounding as G
from offersieve.operators import ledger as L
from offersieve.plans.offers import _literals, _q, _read, _spread, _values
from offersieve.plans.presentation import _BARE, _LINE
from offersieve.sources import items as I

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _made(k, *values):
    """values[i] where k is i; null past the last."""
    out = F.when(F.lit(False), F.lit(values[0]))
    for i, v in enumerate(values):
        out = out.when(k == i, F.lit(v) if isinstance(v, str) else v)
    return out


@query("SELECT p_partkey, ['language', 'ungrounded', 'product', 'price', 'coupons', 'coupons', 'links', 'category', 'field', 'offer_count', 'shape'][p_partkey % 12] AS fault FROM part")
def extraction_faults(spark, sf_dir):
    """Each part as an extraction with the fault of its key; of remainder 0, with none."""
    k = F.col("p_partkey") % 12
    g = lambda v, e=None: F.struct(v.alias("value"), (v if e is None else e).alias("evidence"))
    none = F.lit(None).cast("struct<value:string,evidence:string>")
    name, brand = F.col("p_name"), F.col("p_brand")
    coupons = F.when(k == 5, F.array(g(F.lit("bad code!"), brand))).when(k == 6, F.array(g(F.lit("AB"), brand), g(F.lit("ab"), brand))).otherwise(F.array(g(F.lit("OFF_10"), brand)))
    offer = F.struct(
        F.when(k == 3, none).otherwise(g(name)).alias("product_name"), F.when(k == 4, g(F.lit("abc"), brand)).otherwise(g(F.lit("R$ 10,50"))).alias("current_price"), none.alias("original_price"),
        none.alias("payment_terms"), g(brand, F.when(k == 2, F.lit("not there")).otherwise(brand)).alias("seller"), none.alias("availability"), none.alias("deal_callout"), coupons.alias("coupons"),
        F.array(g(F.when(k == 9, F.lit("<b>x</b>")).otherwise(brand), brand)).alias("highlights"), F.when(k == 8, F.lit("cars")).otherwise(F.lit("home")).alias("category"),
        F.array(F.when(k == 7, F.lit("link_9")).otherwise(F.lit("link_1"))).alias("link_ids"),
    )
    whole = F.struct(F.lit(False).alias("prompt_injection_detected"), F.when(k == 1, F.lit("xx")).otherwise(F.lit("en")).alias("source_language"), F.when(k == 10, F.slice(F.array(offer), 1, 0)).otherwise(F.array(offer)).alias("offers"))
    raw = F.when(k == 11, F.lit("oops")).otherwise(F.to_json(whole, {"ignoreNullFields": "false"}))
    source = F.concat_ws(" ", name, brand, F.lit("R$ 10,50 OFF_10"))
    return _spread(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey").select("p_partkey", G.extraction_fault(raw, source, F.array(F.lit("link_1"), F.lit("link_2"))).alias("fault"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'not_boolean' WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'seller' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'current_price' END AS fault FROM orders")
def verification_faults(spark, sf_dir):
    k = F.col("o_orderkey")
    verdict = lambda name, ok, valid, clash: F.struct(F.lit(name).alias("name"), ok.alias("supported"), valid.alias("evidence_valid"), clash.alias("conflicting"))
    verdicts = F.array(verdict("seller", k % 3 != 0, F.lit(True), F.lit(False)), verdict("current_price", F.when(k % 11 != 0, F.lit(True)), k % 5 != 0, k % 7 == 0), verdict("coupons", F.lit(False), F.lit(False), F.lit(True)))
    present = F.when(k % 2 == 1, F.array(F.lit("seller"), F.lit("current_price"))).otherwise(F.array(F.lit("current_price")))
    return _read(spark, sf_dir, "orders").select("o_orderkey", G.verification_fault(verdicts, present).alias("fault"))


@query("SELECT c_custkey, ['field:product_name', 'highlights', 'presence:availability', 'seller', 'presence:payment_terms'][c_custkey % 7] AS fault FROM customer")
def localization_faults(spark, sf_dir):
    k = F.col("c_custkey") % 7
    none, name, city = F.lit(None).cast("string"), F.col("c_name"), F.col("c_mktsegment")
    fact = {"product_name": name, "availability": city, "seller": name, "deal_callout": none, "payment_terms": none, "highlights": F.array(city)}
    local = {
        "product_name": F.when(k == 1, F.lit("see http://x.test")).otherwise(name), "availability": F.when(k != 3, city), "seller": F.when(k == 4, city).otherwise(name), "deal_callout": none,
        "payment_terms": F.when(k == 5, city), "highlights": F.when(k == 2, F.array(city, city)).otherwise(F.array(city)),
    }
    return _read(spark, sf_dir, "customer").select("c_custkey", G.localization_fault(fact, local).alias("fault"))


REWRITES = ["Good price for a drive.", "One. Two.", "The model likes it", "remodelled kitchen", "v1.5 is out", "", "see https://x.test", "x" * 241]


@query(f"WITH a AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT -1 - id, text FROM {_values(REWRITES)}), p AS (SELECT id, text, {_LINE(_BARE('text'))} AS p FROM a) SELECT id, CASE WHEN text IS NULL OR p = '' OR length(p) > 240 THEN 'empty_or_oversized' WHEN regexp_matches(p, {_q(G.V.MARKUP)}) THEN 'url_or_markup' WHEN regexp_matches(p, {_q(G.V.COMMAND)}) THEN 'command' WHEN len(regexp_extract_all(p, '[.!?](?:\\s|$)')) > 1 THEN 'not_one_sentence' WHEN regexp_matches(p, {_q(G.INTERNAL)}) THEN 'internal_words' END AS fault FROM p")
def reason_faults(spark, sf_dir):
    a = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return a.unionAll(_literals(spark, REWRITES).select((-1 - F.col("id")).alias("id"), "text")).select("id", G.reason_fault(F.col("text")).alias("fault"))


_MONEY = lambda x: f"'R$ ' || translate(format('{{:,.2f}}', {x}::DOUBLE), ',.', '.,')"
_CARD = f"""WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_retailprice::DECIMAL(18,2) AS now, (p_retailprice::DECIMAL(18,2) * 1.25)::DECIMAL(18,2) AS was FROM part),
h AS (SELECT *, CASE WHEN k % 5 = 0 THEN list_transform(range(k % 80), lambda i: p_type) ELSE []::VARCHAR[] END AS hl, CASE WHEN k % 4 = 0 THEN repeat(p_brand, 1 + (k % 90)) END AS seller, CASE WHEN k % 3 = 0 THEN repeat(p_brand, 1 + (k % 50)) ELSE '' END AS av,
  CASE k % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['A1'] ELSE ['A1', 'B2'] END AS cp FROM p),
l AS (SELECT k, unnest([[true, true, true], [false, true, true], [false, false, true], [false, false, false]]) AS o, unnest([1, 2, 3, 4]) AS place, hl, seller, av, cp, now, was, p_name FROM h),
t AS (SELECT k, place, '🏠 ' || p_name || CASE WHEN o[3] AND av <> '' THEN chr(10) || av ELSE '' END || chr(10) || chr(10) || {_MONEY('now')} || '   ' || {_MONEY('was')} || chr(10) || '20% OFF'
  || CASE len(cp) WHEN 0 THEN '' WHEN 1 THEN chr(10) || chr(10) || '🎟️ Cupom' || chr(10) || 'A1' || chr(10) || 'Aplique no carrinho' ELSE chr(10) || chr(10) || '🎟️ Cupons' || chr(10) || 'A1' || chr(10) || 'B2' || chr(10) || 'Aplique um código no carrinho' END
  || CASE WHEN o[2] AND seller IS NOT NULL THEN chr(10) || chr(10) || '🏪 ' || seller ELSE '' END || CASE WHEN o[1] AND len(hl) > 0 THEN chr(10) || chr(10) || array_to_string(list_transform(hl, lambda x: '• ' || x), chr(10)) ELSE '' END || chr(10) || chr(10) || 'Serve.' AS card FROM l)
SELECT p_partkey, c.card FROM part LEFT JOIN (SELECT k, arg_min(card, place) AS card FROM t WHERE length(card) <= 1024 GROUP BY k) c ON k = p_partkey"""


@query(_CARD)
def localized_cards(spark, sf_dir):
    """Cards of one offer each; many have highlights, sellers or availability too long to be shown."""
    k = F.col("p_partkey")
    now = F.col("p_retailprice").cast("decimal(18,2)")
    offer = F.struct(
        F.lit("home").alias("category"), F.col("p_name").alias("product_name"), F.when(k % 3 == 0, F.expr("repeat(p_brand, CAST(1 + p_partkey % 50 AS INT))")).otherwise("").alias("availability"), now.alias("current_price"),
        (now * F.lit("1.25").cast("decimal(3,2)")).cast("decimal(18,2)").alias("original_price"), F.lit(None).cast("string").alias("payment_terms"), F.lit(None).cast("string").alias("deal_callout"),
        _made(k % 3, F.array().cast("array<string>"), F.array(F.lit("A1")), F.array(F.lit("A1"), F.lit("B2"))).alias("coupons"), F.when(k % 4 == 0, F.expr("repeat(p_brand, CAST(1 + p_partkey % 90 AS INT))")).alias("seller"),
        F.when(k % 5 == 0, F.expr("array_repeat(p_type, CAST(p_partkey % 80 AS INT))")).otherwise(F.array().cast("array<string>")).alias("highlights"),
    )
    return _read(spark, sf_dir, "part").select("p_partkey", G.localized_card(F.array(offer), F.lit("Serve.")).alias("card"))


@query("""SELECT p_partkey, position, CASE WHEN position = 1 THEN 'item_not_object' ELSE [NULL, NULL, NULL, 'missing_offer', 'missing_title', 'missing_temperature', 'invalid_timestamp'][k] END AS skip_reason,
  CASE WHEN position = 0 THEN ['2', '3', left(sha256('https://x.test/' || p_partkey), 24), '4', '5', '6', '7'][k] ELSE NULL END AS id_tail, CASE WHEN position = 0 AND k <> 5 THEN p_name END AS title,
  CASE WHEN position = 0 AND k <> 4 THEN 1234.5 END::DOUBLE AS price, CASE WHEN position = 0 THEN [45, 7, -3, 12, 12, NULL, 12][k] END::INTEGER AS temperature
FROM (SELECT *, p_partkey % 7 + 1 AS k FROM part), (VALUES (0), (1)) AS v(position)""")
def feed_items(spark, sf_dir):
    """Each part as a feed of two items, the first in the form or with the fault of its key, the second no object."""
    k = F.col("p_partkey") % 7 + 1
    name, url = F.to_json(F.struct(F.when(k == 5, F.lit(" ")).otherwise(F.col("p_name")).alias("name"))), F.concat(F.lit('"url":"https://x.test/'), "p_partkey", F.lit('"'))
    ids = _made(k - 1, '"sku":"2"', '"@id":"3"', '"sku":""', '"productID":4', '"productID":5', '"productID":6', '"productID":7,"datePublished":"never"')
    heat = _made(k - 1, '"heat":"45 graus"', '"additionalProperty":[{"name":"x","value":9},{"name":"Temperatura","value":7}]', '"aggregateRating":{"ratingValue":"-3.5"}', '"temperature":12', '"temperature":12', '"temperature":"hot"', '"temperature":12')
    offers = _made(k - 1, '"offers":[{"price":"R$ 1.234,50"},{"price":1}]', '"offers":{"price":"R$ 1234,50"}', '"offers":{"price":1234.5}', '"offers":[]', '"offers":{"price":"1234.50"}', '"offers":{"price":"1234.50"}', '"offers":{"price":"1234.50"}')
    item = F.concat(F.lit("{"), F.concat_ws(",", F.substring(name, F.lit(2), F.length(name) - 2), url, ids, heat, offers), F.lit("}"))
    listed = F.concat(F.lit('{"itemListElement":['), F.when(k % 2 == 0, F.concat(F.lit('{"position":1,"item":'), item, F.lit("}"))).otherwise(item), F.lit(',"x"]}'))
    raw = F.when(k == 2, F.concat(F.lit('{"@graph":[{"a":1},'), listed, F.lit("]}"))).otherwise(listed)
    out = I.items(_read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "raw", "p_partkey")
    return out.select("p_partkey", "position", "skip_reason", F.col("id").alias("id_tail"), "title", F.col("price").cast("double").alias("price"), "temperature")


_LAST = "SELECT l_orderkey, l_linestatus, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_linestatus DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1"


@query(f"SELECT o_orderkey, l_linestatus AS outcome, l_quantity::DOUBLE AS tokens FROM orders LEFT JOIN ({_LAST}) ON l_orderkey = o_orderkey")
def completed_attempts(spark, sf_dir):
    done = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_linestatus").alias("outcome"), F.col("l_quantity").cast("double").alias("tokens"))
    return L.completed(_read(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey", ["l_linenumber"], "outcome", ["tokens"]).select("o_orderkey", "outcome", "tokens")


_TOKENS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _attempts(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", *(F.when(F.col("l_linenumber") != 3, F.col(t).cast("decimal(18,2)")).alias(t) for t in _TOKENS))


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS attempts, {', '.join(f'coalesce(sum({t}::DECIMAL(18,2)) FILTER (l_linenumber <> 3), 0)::DOUBLE AS {t}' for t in _TOKENS)} FROM lineitem GROUP BY ALL")
def attempt_usage(spark, sf_dir):
    """Four sums by two keys; every third line has no counts."""
    return L.usage(_attempts(spark, sf_dir), "l_linestatus", "l_returnflag", _TOKENS).select("l_returnflag", "l_linestatus", "attempts", *(F.col(t).cast("double").alias(t) for t in _TOKENS))


@query("SELECT count(*)::BIGINT AS attempts, greatest(0, 65000 - count(*))::BIGINT AS remaining, greatest(0, 20000 - count(*) FILTER (l_returnflag = 'A'))::BIGINT AS remaining_A, greatest(0, 100 - count(*) FILTER (l_returnflag = 'R'))::BIGINT AS remaining_R FROM lineitem")
def budget_left(spark, sf_dir):
    return L.remaining(L.usage(_attempts(spark, sf_dir), "l_linestatus", "l_returnflag", _TOKENS), "l_returnflag", {"A": 20_000, "R": 100}, 65_000)


_NOON = "TIMESTAMP '2024-01-02 12:00:00'"


@query(f"SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('error', 'purchase')) WHERE r = 1 AND event_type = 'error' AND ts + INTERVAL 12 HOUR > {_NOON}")
def circuits_open(spark, sf_dir):
    e = _read(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("opened"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("until"))
    return L.open_circuits(e, "user_id", ["ts", "event_id"], "opened", "until", F.expr(_NOON)).select("user_id")


@query("SELECT role, conv_id, payload FROM (SELECT role, conv_id, ['[1]', 'oops', repeat('x', 70000)][turn % 4] AS bad, coalesce(bad, '{\"turn\": ' || turn || '}') AS payload, row_number() OVER (PARTITION BY role, conv_id ORDER BY turn) AS r FROM conversations WHERE turn % 4 <> 3) WHERE r = 1 AND bad IS NULL")
def cache_hits(spark, sf_dir):
    """A value is put for every turn; only the first of a key stays, and what is no object is no hit."""
    payload = F.coalesce(_made(F.col("turn") % 4 - 1, "[1]", "oops", F.repeat(F.lit("x"), 70_000)), F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}")))
    puts = _read(spark, sf_dir, "conversations").select("role", "conv_id", "turn", payload.alias("payload"))
    return L.cached(puts, ["role", "conv_id"], ["turn"], "payload")


HINTS = ["pt", "pt_BR", "PT-br", "en-GB", "fr", "", " pt-PT ", "english", "EN"]
_LOCALES = ", ".join(f"({i}, {_q(h)})" for i, h in enumerate(HINTS))


@query(f"WITH a AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN lang END AS stored, CASE WHEN doc_id % 5 = 0 THEN 'pt' END AS resolved, lang AS hint FROM documents UNION ALL SELECT -1 - id, NULL, NULL, h FROM (VALUES {_LOCALES}) AS v(id, h)) SELECT id, CASE WHEN starts_with(replace(lower(trim(coalesce(stored, resolved, hint, ''))), '_', '-') || '-', 'pt-') THEN 'pt-BR' ELSE 'en' END AS locale FROM a")
def ui_languages(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("stored"), F.when(F.col("doc_id") % 5 == 0, F.lit("pt")).alias("resolved"), F.col("lang").alias("hint"))
    none = F.lit(None).cast("string")
    d = d.unionAll(_literals(spark, HINTS).select((-1 - F.col("id")).alias("id"), none, none, F.col("text")))
    return d.select("id", L.ui_language(F.col("stored"), F.col("resolved"), F.col("hint")).alias("locale"))


@query("SELECT source, count(DISTINCT lang) AS n_locales, count(DISTINCT length(source) + (doc_id % 997 = 0)::INTEGER) AS n_shapes FROM documents GROUP BY source HAVING count(DISTINCT lang) < (SELECT count(DISTINCT lang) FROM documents) OR count(DISTINCT length(source) + (doc_id % 997 = 0)::INTEGER) > 1")
def catalog_gaps(spark, sf_dir):
    shape = F.length("source") + (F.col("doc_id") % 997 == 0).cast("int")
    return L.catalog_gaps(_read(spark, sf_dir, "documents").select("lang", "source", shape.alias("shape")), "lang", "source", "shape")


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 OR event_type = 'error' THEN 'discard' WHEN value > 50 THEN 'forward' ELSE 'discard' END AS decision, CASE WHEN event_id % 13 = 0 THEN 'gemini_evaluation_disabled' WHEN event_id % 5 = 0 THEN 'price_above_maximum:a' WHEN event_id % 7 = 0 THEN 'interest_candidate_miss' WHEN event_type = 'error' THEN 'retry_daily_budget_exhausted' ELSE event_type END AS reason, CASE WHEN event_type <> 'error' THEN CASE WHEN value > 50 THEN 'forward' ELSE 'discard' END END AS shadow, CASE WHEN event_type = 'error' THEN 'audit_error:error' ELSE 'below_threshold:' || event_type END AS audit FROM events")
def retry_and_audit(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    label = F.when(F.col("value") > 50, F.lit("forward")).otherwise(F.lit("discard"))
    retry = L.retry_verdict(i % 13 != 0, F.when(i % 5 == 0, F.lit("price_above_maximum:a")), (i % 7).cast("int"), F.when(kind == "error", F.lit("daily_budget")).otherwise(F.lit("ok")), label, kind)
    audit = L.audit_verdict(F.when(kind == "error", kind), label, kind)
    return _read(spark, sf_dir, "events").select("event_id", retry.alias("r"), audit.alias("a")).select("event_id", "r.decision", "r.reason", F.col("a.shadow_decision").alias("shadow"), F.col("a.reason").alias("audit"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'retryable' WHEN s = 429 OR s BETWEEN 500 AND 599 THEN 'retryable' WHEN s >= 400 THEN 'permanent' WHEN event_id % 4 = 0 THEN 'retryable' WHEN event_id % 6 = 1 THEN 'permanent' ELSE 'sent' END AS outcome FROM (SELECT event_id, [200, 400, 429, 500, 599, 600, 302][event_id % 7 + 1] AS s FROM events)")
def delivery_outcomes(spark, sf_dir):
    i = F.col("event_id")
    status = F.when(i % 9 != 0, F.element_at(F.array(*map(F.lit, (200, 400, 429, 500, 599, 600, 302))), (i % 7 + 1).cast("int")))
    return _read(spark, sf_dir, "events").select("event_id", L.delivery_outcome(status, i % 4 != 0, i % 6 != 1).alias("outcome"))


_THEN = "TIMESTAMP '1997-06-15 00:14:59'"


@query(f"SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderkey = m AND o_orderdate + INTERVAL 15 MINUTE > {_THEN} AND o_orderkey % 5 <= 3")
def clarifications_open(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderkey") % 5).alias("rounds"))
    current = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return L.open_clarifications(o, current, "o_custkey", "o_orderkey", "at", "rounds", F.expr(_THEN)).select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS min_price, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice::DOUBLE END AS max_price, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'brand=' || p_brand || ';type=' || p_type || '|' || p_brand END AS attributes, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END::INTEGER AS n_excluded FROM part")
def constraint_rows(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.to_json(F.struct(F.when(k % 2 == 0, F.col("p_size")).alias("min_price"), F.when(k % 3 == 0, F.col("p_retailprice").cast("string")).alias("max_price"), F.when(k % 5 != 0, F.struct(F.array("p_type", "p_brand").alias("type"), F.array("p_brand").alias("brand"))).alias("attributes"), F.when(k % 7 == 0, F.array(F.lit("used"))).alias("excluded_attributes")))
    c = _read(spark, sf_dir, "part").select("p_partkey", L.constraint(raw).alias("c"))
    shown = F.array_join(F.transform("c.attributes", lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], "|"))), ";")
    return c.select("p_partkey", F.col("c.min_price").cast("double").alias("min_price"), F.col("c.max_price").cast("double").alias("max_price"), shown.alias("attributes"), F.size("c.excluded").alias("n_excluded"))


@query("WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS v FROM documents) SELECT doc_id, len(list_distinct(v))::INTEGER AS n, CASE WHEN len(list_filter(v, lambda x: x = '')) > 0 THEN 'empty_value' WHEN len(list_filter(v, lambda x: strlen(x) > 500)) > 0 THEN 'too_long' END AS fault FROM t")
def string_lists(spark, sf_dir):
    values, fault = L.string_list(F.split("text", "\n"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(values).alias("n"), fault.alias("fault"))
