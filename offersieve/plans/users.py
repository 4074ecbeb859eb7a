"""The cascade for stored users: documents as offers, nations as users, and each user's interests, aliases, exclusions and
rules as rows whose words come from documents of the same tables. Both forms build the same tables and judge every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.functions import text as X
from offersieve.operators import fanout
from offersieve.operators import relevance as R
from offersieve.operators.lineage import written
from offersieve.plans.offers import _CUT, _PHRASES, _RUNS, DOCS, _list, _q, _read, _sig, sql_norm

QUERIES: dict = {}
ORACLE: dict = {}

#: Where in a document's significant tokens a user's words are taken: first word and how many.
PLACES = {"a1": ("w", 5, 2), "a2": ("w", 9, 1), "ax": ("w", 20, 1), "b1": ("v", 12, 1), "g1": ("v", 3, 2), "g2": ("v", 7, 1), "g3": ("w", 9, 1), "e0": ("v", 15, 2), "e1": ("v", 7, 1), "r1": ("t", 4, 2), "r2": ("t", 30, 1), "r3": ("t", 4, 1)}
HEAT = "CASE WHEN doc_id % 9 = 4 THEN {source} ELSE source END"


def offers_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with a price of a part, and heat by their id: texts, read and normalised once, and small rows."""
    prices = _read(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("part"), F.col("p_retailprice").cast("double").alias("price"))
    d = _sig(spark, sf_dir).withColumns({"hot": F.when(F.col("doc_id") % 9 == 4, R.HEAT_SOURCE).otherwise(F.col("source")), "heat": (F.col("doc_id") * 37 % 400).cast("int")})
    d = written(d.select("doc_id", F.array_join("tokens", " ").alias("words"), F.size("sig").alias("n_sig"), X.tokens(X.normalize(F.split("text", "\n")[0])).alias("title_tokens"), R.fixed_reason(F.col("norm"), F.col("text")).alias("fixed"), R.exceptional_reason(F.col("hot"), F.col("heat"), F.col("norm")).alias("exceptional"), F.sha2("norm", 256).alias("h")))
    small = d.drop("words")
    small = small.join(small.groupBy("h").agg(F.min("doc_id").alias("first")), "h").withColumn("replay", F.col("doc_id") > F.col("first"))
    priced = small.join(prices, (F.col("part") == F.col("doc_id")) & (F.col("doc_id") % 3 != 0), "left")
    return d.select("doc_id", "words"), written(priced.select("doc_id", "n_sig", "title_tokens", "price", "fixed", "exceptional", "replay"))


def tables_of(spark: SparkSession, sf_dir: str, texts: DataFrame) -> dict[str, DataFrame]:
    """users, interests, aliases, exclusions and rules."""
    u = _read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("user_id"))
    # Only the texts that users take words from are split, and of those the first tokens that reach all places are kept.
    t = F.split("words", " ")
    named = u.select(F.explode(F.array(F.col("user_id") * 3, F.col("user_id") * 3 + 1)).alias("doc_id"))
    of = texts.join(named, "doc_id", "left_semi").select("doc_id", F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(t).alias("t")).select("doc_id", F.slice(X.significant(F.col("t")), 1, 40).alias("v"), F.slice("t", 1, 40).alias("t"))
    w = of.filter("doc_id % 3 = 0").select((F.col("doc_id") / 3).cast("long").alias("user_id"), F.col("v").alias("w"))
    v = of.filter("doc_id % 3 = 1").select(((F.col("doc_id") - 1) / 3).cast("long").alias("user_id"), "v", "t")
    s = u.join(w, "user_id", "left").join(v, "user_id", "left")
    s = written(s.select("user_id", *(F.coalesce(F.slice(c, a, n), F.array().cast("array<string>")).alias(k) for k, (c, a, n) in PLACES.items())))
    m = lambda n: F.col("user_id") % n
    users = s.select("user_id", (m(3) == 0).alias("exceptional_on"), (m(5) * 1.0).cast("double").alias("threshold"), F.when(m(4) == 1, "live").when(m(4) == 3, "off").otherwise("shadow").alias("mode"))
    none = F.lit(None).cast("double")
    a = s.filter(m(10) != 7).select("user_id", F.lit("a").alias("interest_id"), F.array("a1", "a2").alias("terms"), (20 + m(80)).alias("importance"), F.when(m(4) == 1, 1500.0).alias("min_price"), F.when(m(2) == 0, 1400.0).alias("max_price"), F.array("ax").alias("excluded"))
    b = s.filter((m(10) != 7) & (m(2) == 1)).select("user_id", F.lit("b"), F.array("b1"), F.lit(60).cast("long"), none, none, F.array().cast("array<array<string>>"))
    aliases = s.filter((m(3) != 1) & (F.size("g1") > 0)).select("user_id", F.array_join("g1", "_").alias("marker"), F.array("g1", "g2", "g3").alias("variants"))
    outs = s.filter(m(5) == 2).select("user_id", F.posexplode(F.array("e0", "e1")).alias("ord", "phrase"))
    rule = lambda where, p, name, action, parts: s.filter(where).select("user_id", F.lit(p).alias("priority"), F.lit(name).alias("rule_id"), F.lit(action).alias("action"), parts.alias("parts"))
    rules = rule(m(6) == 0, 10, "r1", "deny", F.array(F.array("r1"), F.array(F.col("r2"), F.array(F.lit("zz"))))).union(rule(m(6) == 0, 20, "r2", "allow", F.array(F.array("r2")))).union(rule(m(6) == 3, 5, "r0", "allow", F.array(F.array("r3")))).union(rule(m(6) == 3, 7, "r3", "deny", F.array(F.array("r3"))))
    return {"users": users, "interests": a.union(b), "aliases": aliases, "exclusions": outs, "rules": rules}


def _cut(c: str, a: int, n: int) -> str:
    return f"coalesce({c}[{a}:{a + n - 1}], []::VARCHAR[])"


def _has(tokens: str, wanted: str) -> str:
    return f"(len({wanted}) > 0 AND list_has_all({tokens}, {wanted}))"


def _stands(tokens: str, phrase: str) -> str:
    return f"(len({phrase}) > 0 AND contains(' ' || array_to_string({tokens}, ' ') || ' ', ' ' || array_to_string({phrase}, ' ') || ' '))"


def _drawn(column: str) -> str:
    """A user's tokens drawn together by the user's own aliases."""
    return f"list_distinct(list_concat(list_filter({column}, lambda x: NOT list_contains(flatten(list_filter(gv, lambda y: list_has_all({column}, y))), x)), CASE WHEN len(list_filter(gv, lambda y: list_has_all({column}, y))) > 0 THEN [marker] ELSE []::VARCHAR[] END)) AS {column}_c"


def sql_pairs() -> str:
    """Every document against every user: pairs with stage, reason, score, and whether anything of the user stands in it."""
    chatter = f"regexp_matches(norm, {_q(R.CHATTER[0])}) OR regexp_matches(norm, {_q(R.CHATTER[1])})"
    fixed = f"CASE WHEN NOT regexp_matches(norm, '[a-z0-9]') THEN 'empty_text_or_caption' WHEN {chatter} THEN 'conversation_or_spam' WHEN len(regexp_extract_all(lower(text), 'https?://')) > 4 THEN 'link_spam' WHEN regexp_matches(norm, {_q(_RUNS)}) THEN 'repeated_character_spam' END"
    heat = f"CASE WHEN lower({HEAT.format(source=_q(R.HEAT_SOURCE))}) = {_q(R.HEAT_SOURCE)} AND doc_id * 37 % 400 >= 300 THEN {_q(R.HEAT_REASON)} || (doc_id * 37 % 400) {_PHRASES} WHEN cut > 50 AND cut <= 100 THEN 'stated_discount:' || regexp_replace(cut::VARCHAR, '\\.0$', '') || '%' END"
    tokens_of = lambda x: f"regexp_extract_all({sql_norm(x)}, '[a-z0-9]+(?:_[a-z0-9]+)*')"
    return f"""WITH {DOCS}, o0 AS (SELECT *, {_CUT} AS cut FROM d),
    o AS (SELECT doc_id, {tokens_of('string_split(text, chr(10))[1]')} AS title_tokens, tokens, sig, CASE WHEN doc_id % 3 <> 0 THEN p_retailprice::DOUBLE END AS price, {fixed} AS fixed, {heat} AS exceptional, doc_id > min(doc_id) OVER (PARTITION BY norm) AS replay FROM o0 LEFT JOIN part ON p_partkey - 1 = doc_id),
    s AS (SELECT n_nationkey::BIGINT + 1 AS user_id, {', '.join(f'{_cut(c, a, n)} AS {k}' for k, (c, a, n) in PLACES.items())} FROM nation LEFT JOIN (SELECT doc_id AS wd, sig AS w FROM o) ON wd = (n_nationkey + 1) * 3 LEFT JOIN (SELECT doc_id AS vd, sig AS v, tokens AS t FROM o) ON vd = (n_nationkey + 1) * 3 + 1),
    g AS (SELECT *, array_to_string(g1, '_') AS marker, CASE WHEN user_id % 3 <> 1 AND len(g1) > 0 THEN list_filter([g1, g2, g3], lambda y: len(y) > 0) ELSE []::VARCHAR[][] END AS gv, user_id % 10 <> 7 AS has_a, user_id % 10 <> 7 AND user_id % 2 = 1 AS has_b, user_id % 3 = 0 AS on_, (user_id % 5)::DOUBLE AS threshold, CASE WHEN user_id % 4 = 1 THEN 'live' WHEN user_id % 4 = 3 THEN 'off' ELSE 'shadow' END AS mode FROM s),
    u AS (SELECT *, {', '.join(_drawn(c) for c in ('a1', 'a2', 'ax', 'b1', 'e1', 'e0'))} FROM g),
    w AS (SELECT user_id, token, max(w) AS w FROM (SELECT user_id, unnest(list_concat(a1_c, a2_c)) AS token, 0.5::DOUBLE + (20 + user_id % 80)::DOUBLE / 100 AS w FROM u WHERE has_a UNION ALL SELECT user_id, unnest(b1_c), 0.5::DOUBLE + 0.6::DOUBLE FROM u WHERE has_b) GROUP BY user_id, token),
    h AS (SELECT o.*, u.*, list_filter(gv, lambda y: list_has_all(sig, y)) AS hits FROM o, u),
    h2 AS (SELECT *, flatten(hits) AS gone FROM h),
    c AS (SELECT *, list_concat(list_filter(sig, lambda x: NOT list_contains(gone, x)), CASE WHEN len(hits) > 0 THEN [marker] ELSE []::VARCHAR[] END) AS canon FROM h2),
    nn AS (SELECT user_id, count(*) AS n, avg(len(canon))::DOUBLE AS avgdl FROM c WHERE NOT replay GROUP BY user_id),
    f AS (SELECT * FROM (SELECT doc_id, c.user_id, len(canon) AS len, token, w, len(list_filter(canon, lambda x: x = token))::DOUBLE AS tf FROM c JOIN w ON w.user_id = c.user_id WHERE NOT replay) WHERE tf > 0),
    z AS (SELECT user_id, token, count(*) AS df FROM f GROUP BY user_id, token),
    k AS (SELECT doc_id, user_id, sum(w * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / greatest(avgdl, 1.0::DOUBLE)))) AS score FROM f JOIN z USING (user_id, token) JOIN nn USING (user_id) GROUP BY doc_id, user_id),
    m AS (SELECT *, has_a AND ({_has('canon', 'a1_c')} OR {_has('canon', 'a2_c')}) AS ma, has_b AND {_has('canon', 'b1_c')} AS mb,
        CASE WHEN user_id % 5 = 2 THEN CASE WHEN {_stands('sig', 'e0')} OR (list_contains(list_transform(gv, lambda y: list_sort(list_distinct(y))), list_sort(list_distinct(e0))) AND {_has('canon', 'e0_c')}) THEN array_to_string(e0, ' ') WHEN {_stands('sig', 'e1')} OR (list_contains(list_transform(gv, lambda y: list_sort(list_distinct(y))), list_sort(list_distinct(e1))) AND {_has('canon', 'e1_c')}) THEN array_to_string(e1, ' ') END END AS excluded,
        CASE WHEN user_id % 6 = 3 AND {_stands('tokens', 'r3')} THEN 'rule_allow:r0' WHEN user_id % 6 = 0 AND {_stands('tokens', 'r1')} AND ({_stands('tokens', 'r2')} OR {_stands('tokens', "['zz']")}) THEN 'rule_deny:r1' WHEN user_id % 6 = 0 AND {_stands('tokens', 'r2')} THEN 'rule_allow:r2' END AS rule FROM c),
    q AS (SELECT *, ma OR mb AS met, CASE WHEN ma THEN CASE WHEN user_id % 4 = 1 AND price < 1500 THEN 'price_below_minimum:a' WHEN user_id % 2 = 0 AND price > 1400 THEN 'price_above_maximum:a' WHEN {_has('canon', 'ax_c')} THEN 'excluded_attribute:a:' || array_to_string(ax, ' ') END END AS violation,
        NOT ma OR NOT (user_id % 4 = 1 OR user_id % 2 = 0) OR price IS NOT NULL AS sure, NOT list_has_any(coalesce(title_tokens, []::VARCHAR[])[1:3], {_list(R.ACCESSORIES)}) OR list_has_any(list_concat(CASE WHEN ma THEN list_concat(CASE WHEN {_has('canon', 'a1_c')} THEN a1 ELSE []::VARCHAR[] END, CASE WHEN {_has('canon', 'a2_c')} THEN a2 ELSE []::VARCHAR[] END) ELSE []::VARCHAR[] END, CASE WHEN mb THEN b1 ELSE []::VARCHAR[] END), {_list(R.ACCESSORIES)}) AS clean FROM m),
    x AS (SELECT q.*, score, on_ AND exceptional IS NOT NULL AND met AND NOT sure AS uncertain, greatest(7.0::DOUBLE, threshold + 1) AS top, met AND sure AND clean AS gates FROM q LEFT JOIN k USING (doc_id, user_id)),
    y AS (SELECT *, CASE WHEN NOT uncertain THEN coalesce(score, 0) END AS sc FROM x),
    r AS (SELECT doc_id, user_id, score, excluded IS NOT NULL OR rule IS NOT NULL OR met OR score IS NOT NULL AS near, CASE WHEN NOT has_a AND NOT has_b AND NOT on_ THEN 'idle' WHEN replay THEN 'deduplication' WHEN fixed IS NOT NULL THEN 'hard_filter' WHEN excluded IS NOT NULL THEN 'exclusion' WHEN starts_with(rule, 'rule_deny:') THEN 'hard_filter' WHEN violation IS NOT NULL THEN 'constraints' WHEN on_ AND exceptional IS NOT NULL AND NOT uncertain THEN 'exceptional' WHEN sc < threshold THEN 'bm25' WHEN sc >= top AND gates AND mode = 'live' THEN 'bm25_auto_forward' WHEN NOT met THEN 'interest_admission' ELSE 'deterministic' END AS stage,
        CASE WHEN NOT has_a AND NOT has_b AND NOT on_ THEN 'no_interests_and_exceptional_disabled' WHEN replay THEN 'native_replay' WHEN fixed IS NOT NULL THEN fixed WHEN excluded IS NOT NULL THEN 'explicit_exclusion:' || excluded WHEN starts_with(rule, 'rule_deny:') THEN rule WHEN violation IS NOT NULL THEN violation WHEN on_ AND exceptional IS NOT NULL AND NOT uncertain THEN exceptional WHEN sc < threshold THEN 'below_threshold' WHEN sc >= top AND gates AND mode = 'live' THEN 'above_threshold_with_deterministic_gates' WHEN NOT met THEN 'interest_candidate_miss'
        ELSE 'gemini_evaluation_disabled:' || CASE WHEN uncertain THEN 'uncertain_exceptional' WHEN sc < top THEN 'below_auto_forward_threshold' WHEN NOT gates THEN 'deterministic_gates_failed' WHEN mode = 'off' THEN 'auto_forward_off' ELSE 'auto_forward_shadow' END END AS reason FROM y)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query(f"{sql_pairs()} SELECT doc_id, user_id, stage, reason, round(score, 6) AS score FROM r WHERE near")
def user_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every pair of a document and a stored user in which anything of the user stands."""
    texts, offers = offers_of(spark, sf_dir)
    made = fanout.decisions(texts, offers, **tables_of(spark, sf_dir, texts))
    return made.select("doc_id", "user_id", "stage", "reason", F.round("score", 6).alias("score"))


@query(f"{sql_pairs()} SELECT user_id, stage, reason, count(*) AS n FROM r GROUP BY user_id, stage, reason")
def user_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every stored user, how many documents end at which stage and why: all pairs."""
    texts, offers = offers_of(spark, sf_dir)
    tables = tables_of(spark, sf_dir, texts)
    made = written(fanout.decisions(texts, offers, **tables).drop("score"))
    return fanout.decision_counts(offers, tables["users"], made, tables["interests"])
