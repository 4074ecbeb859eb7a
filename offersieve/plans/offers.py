"""Queries of the relevance cascade on the driver tables, each with its SQL. Documents stand for offers: the first line
is the title, doc_id the order of arrival. Rules, aliases and interests are the literals below, shared by both forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offersieve.functions import text as X
from offersieve.operators import arrivals as A
from offersieve.operators import relevance as R
from offersieve.operators.lineage import written

ALIASES = {"the thing": ["ation", "on the"], "de la": ["que", "les"]}
EXCLUSIONS = ["the of and", "on the", "und der"]
RULES = [R.Rule("pair", 10, "allow", all=[["the of", "of the"], ["and the", "in the"]]), R.Rule("der", 200, "deny", any=["der die", "und der"]), R.Rule("que", 210, "deny", any=["que", "los"])]
INTERESTS = [R.Interest("int-a", ["of", "ation"], 80), R.Interest("int-b", ["und die", "que"], 30)]
PRICES = ["R$ 1.299,90", "299.90", "R$2.645", "R$ 1.234.567", "R$119", "$12.34", "1.000", "12,5", "sem preco", "0"]
STATED = ["SSD por R$ 299,90 com 55% de desconto", "De R$ 599 por R$ 339 em 7x", "SSD com 55% de desconto", "custa 45 reais hoje", "por apenas 10", "nada"]
OFFERS = [(-1, "pelando", 300, "SSD barato"), (-2, "telegram", 999, "SSD barato"), (-3, "telegram", 0, "ERRO DE PREÇO em notebook"), (-4, "telegram", 0, "SSD com 55% de desconto"), (-5, "telegram", 0, "SSD com 50% de desconto"), (-6, "x", 0, "economize 60%"), (-7, "pelando", 299, "De 100 por 40")]
SPAM = [(-1, ""), (-2, "Bom dia, OneBlade refil, vale a pena?"), (-3, "http://a http://b http://c https://d http://e"), (-4, "Curso zzzzzzzzzzzz"), (-5, "!!!"), (-6, "Refil lâminas OneBlade")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")


def _spread(d: DataFrame, key: str) -> DataFrame:
    """A file of one row group, or of few bytes, is one task however large the cluster: where there are fewer splits than
    cores, rows are spread by key before costly work. A table of many splits is read as it is."""
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(cores, key) if d.rdd.getNumPartitions() < cores else d


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir)
    return d.select("doc_id", F.split("text", "\n")[0].alias("title"), "text", "source", F.lit(None).cast("decimal(18,2)").alias("price"))


def _sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = X.normalize(F.col("text"))
    return _texts(spark, sf_dir).select("doc_id", "source", "text", norm.alias("norm")).withColumns({"tokens": X.tokens(F.col("norm")), "sig": X.significant_of(F.col("norm"))})


# SQL pieces -----------------------------------------------------------------------------------------------------------
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]::VARCHAR[]"


def sql_norm(t: str) -> str:
    x = f"strip_accents(replace(lower(coalesce({t}, '')), 'ß', 'ss'))"
    for pattern, to in ((r"https?://[^\s<>]+", " url "), (r"([0-9]{1,3}(?:[.,][0-9]+)?)\s*%", r" \1 percent "), (r"r\$\s*", " brl "), (r"\bus\$|\busd\b", " usd "), (r"[^a-z0-9_.,]+", " "), ("([0-9]),([0-9])", r"\1.\2"), ("([0-9]),([0-9])", r"\1.\2"), (r"[^a-z0-9_.]+", " "), (" +", " ")):
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(to)}, 'g')"
    return f"trim({x})"


TOKENS = "regexp_extract_all(norm, '[a-z0-9]+(?:_[a-z0-9]+)*')"
SIG = f"list_filter(flatten(list_transform(tokens, lambda x: regexp_extract_all(x, '[a-z]+|[0-9]+'))), lambda x: NOT list_contains({_list(X.CONNECTORS)}, x))"
DOCS = f"n AS (SELECT doc_id, source, text, {sql_norm('text')} AS norm FROM documents), t AS (SELECT *, {TOKENS} AS tokens FROM n), d AS (SELECT *, {SIG} AS sig FROM t)"


def sql_phrase(tokens: str, phrase: list[str]) -> str:
    return f"contains(' ' || array_to_string({tokens}, ' ') || ' ', {_q(' ' + ' '.join(phrase) + ' ')})"


def sql_covers(tokens: str, wanted: list[str]) -> str:
    return f"list_has_all({tokens}, {_list(wanted)})" if wanted else "false"


def sql_canonical(table: str, sig: str, groups: list) -> str:
    """A SELECT of the table with canon: what matching variants remove is a column before the filter refers to it."""
    gone, marks = [], []
    for marker, variants in groups:
        hits = [sql_covers(sig, v) for v in variants if v]
        gone += [f"CASE WHEN {sql_covers(sig, v)} THEN {_list(v)} ELSE []::VARCHAR[] END" for v in variants if v]
        marks.append(f"CASE WHEN {' OR '.join(hits)} THEN {_list([marker])} ELSE []::VARCHAR[] END")
    inner = f"SELECT *, flatten([{', '.join(gone)}]) AS gone, flatten([{', '.join(marks)}]) AS marks FROM {table}"
    return f"SELECT *, list_concat(list_filter({sig}, lambda x: NOT list_contains(gone, x)), marks) AS canon FROM ({inner})"


def sql_bm25(weights: dict[str, float], tokens: str, n: str = "n", avgdl: str = "avgdl") -> str:
    parts = []
    for i, (t, w) in enumerate(weights.items()):
        tf = f"len(list_filter({tokens}, lambda x: x = {_q(t)}))::DOUBLE"
        parts.append(f"{float(w)}::DOUBLE * ln(1 + ({n} - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len({tokens}) / greatest({avgdl}, 1.0::DOUBLE)))")
    return " + ".join(parts)


def sql_stats(weights: dict[str, float], tokens: str, table: str) -> str:
    dfs = ", ".join(f"sum(CASE WHEN list_contains({tokens}, {_q(t)}) THEN 1 ELSE 0 END)::BIGINT AS df{i}" for i, t in enumerate(weights))
    return f"s AS (SELECT count(*) AS n, avg(len({tokens}))::DOUBLE AS avgdl, {dfs} FROM {table})"


GROUPS = X.alias_groups(ALIASES)
CANON = f"{DOCS}, c AS ({sql_canonical('d', 'sig', GROUPS)})"

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {DOCS} SELECT doc_id, norm FROM d")
def normalize_documents(spark, sf_dir):
    return _sig(spark, sf_dir).select("doc_id", "norm")


@query(f"WITH {DOCS} SELECT doc_id, len(tokens)::BIGINT AS n_tokens, len(sig)::BIGINT AS n_significant, len(list_distinct(sig))::BIGINT AS n_distinct FROM d")
def token_stats(spark, sf_dir):
    return _sig(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size("sig").cast("long").alias("n_significant"), F.size(F.array_distinct("sig")).cast("long").alias("n_distinct"))


HASH = f"sha256({sql_norm('''string_split(text, chr(10))[1] || ' ' || text''')} || chr(31) || '')"


def _hashed(spark, sf_dir):
    o = _offers(spark, sf_dir)
    return o.select("doc_id", "source", X.content_hash(F.col("title"), F.col("text"), F.col("price"), F.array().cast("array<string>")).alias("content_hash"))


@query(f"SELECT doc_id, {HASH} AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _hashed(spark, sf_dir).select("doc_id", "content_hash")


@query(f"SELECT doc_id FROM (SELECT doc_id, {HASH} AS h FROM documents) WHERE ('0x' || substr(h, 1, 15))::UBIGINT::DOUBLE / 1152921504606846975 < 0.05")
def hash_sample_5pct(spark, sf_dir):
    return _hashed(spark, sf_dir).filter(X.hash_share(F.col("content_hash")) < 0.05).select("doc_id")


_SPAM = "SELECT doc_id AS id, 'document' AS kind, text FROM documents UNION ALL SELECT conv_id * 1000 + turn, 'message', text FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, 'literal', {_q(t)})" for i, t in SPAM) + ")"
_RUNS = "|".join(c + "{10,}" for c in [*"abcdefghijklmnopqrstuvwxyz0123456789_", r"\."])


@query(f"WITH a AS ({_SPAM}), n AS (SELECT *, {sql_norm('text')} AS norm FROM a) SELECT id, kind, CASE WHEN NOT regexp_matches(norm, '[a-z0-9]') THEN 'empty_text_or_caption' WHEN regexp_matches(norm, {_q(R.CHATTER[0])}) OR regexp_matches(norm, {_q(R.CHATTER[1])}) THEN 'conversation_or_spam' WHEN len(regexp_extract_all(lower(text), 'https?://')) > 4 THEN 'link_spam' WHEN regexp_matches(norm, {_q(_RUNS)}) THEN 'repeated_character_spam' END AS reason FROM n")
def fixed_filter_reasons(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "text")
    messages = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("message").alias("kind"), "text")
    literals = spark.createDataFrame([(i, "literal", t) for i, t in SPAM], "id long, kind string, text string")
    return docs.unionAll(messages).unionAll(literals).withColumn("norm", X.normalize(F.col("text"))).select("id", "kind", R.fixed_reason(F.col("norm"), F.col("text")).alias("reason"))


def sql_rules(tokens: str) -> str:
    out = []
    phrase = lambda p: sql_phrase(tokens, X.normal_py(p).split())
    for r in sorted(RULES, key=lambda r: r.priority):
        parts = (["(" + " OR ".join(map(phrase, r.any)) + ")"] if r.any else []) + ["(" + " OR ".join(map(phrase, g)) + ")" for g in r.all]
        out.append(f"WHEN {' AND '.join(parts)} THEN 'rule_{r.action}:{r.rule_id}'")
    return "CASE " + " ".join(out) + " END"


def sql_exclusion(sig: str) -> str:
    groups = X.alias_groups(ALIASES)
    members = {tuple(v) for _, variants in groups for v in variants}
    out = []
    for e in EXCLUSIONS:
        base = X.significant_py(e)
        hit = sql_phrase(sig, base) if base else "false"
        if tuple(base) in members:
            hit += " OR " + sql_covers("canon", X.canonical_py(base, groups))
        out.append(f"WHEN {hit} THEN {_q(e)}")
    return "CASE " + " ".join(out) + " END"


@query(f"WITH {DOCS} SELECT doc_id, {sql_rules('tokens')} AS reason FROM d")
def rule_filter_first_match(spark, sf_dir):
    return _sig(spark, sf_dir).select("doc_id", R.rule_reason(F.col("tokens"), RULES).alias("reason"))


@query(f"WITH {CANON} SELECT doc_id, {sql_exclusion('sig')} AS excluded FROM c")
def exclusion_match(spark, sf_dir):
    return _sig(spark, sf_dir).select("doc_id", R.exclusion(F.col("sig"), EXCLUSIONS, ALIASES).alias("excluded"))


_DISCOUNT1 = r"\b(?:desconto|discount|off|economize)\b[^0-9]{0,12}([0-9]{1,3}(?:[.,][0-9]+)?)\s*(?:%|percent)\b|([0-9]{1,3}(?:[.,][0-9]+)?)\s*(?:%|percent)\s*(?:de\s+)?(?:desconto|discount|off)\b"
_CUT = f"try_cast(replace(coalesce(nullif(regexp_extract(norm, {_q(_DISCOUNT1)}, 1), ''), nullif(regexp_extract(norm, {_q(_DISCOUNT1)}, 2), '')), ',', '.') AS DOUBLE)"
_PHRASES = " ".join(f"WHEN contains(norm, {_q(p)}) THEN {_q('explicit_phrase:' + p)}" for p in R.EXCEPTIONAL)


@query(f"WITH a AS (SELECT doc_id AS id, source, 0 AS temperature, text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f'({i}, {_q(s)}, {t}, {_q(x)})' for i, s, t, x in OFFERS)})), m AS (SELECT *, {sql_norm('text')} AS norm FROM a), n AS (SELECT *, {_CUT} AS cut FROM m) SELECT id, CASE WHEN lower(source) = 'pelando' AND temperature >= 300 THEN 'pelando_temperature:' || temperature {_PHRASES} WHEN cut > 50 AND cut <= 100 THEN 'stated_discount:' || regexp_replace(cut::VARCHAR, '\\.0$', '') || '%' END AS reason FROM n")
def exceptional_offers(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.lit(0).alias("temperature"), "text")
    a = docs.unionAll(spark.createDataFrame(OFFERS, "id long, source string, temperature int, text string")).withColumn("norm", X.normalize(F.col("text")))
    return a.select("id", R.exceptional_reason(F.col("source"), F.col("temperature"), F.col("norm")).alias("reason"))


def sql_price(t: str) -> str:
    f = rf"regexp_replace(regexp_extract({t}, '([0-9]{{1,3}}(?:[.\s][0-9]{{3}})+(?:,[0-9]{{1,2}})?|[0-9]+(?:[.,][0-9]{{1,2}})?)', 1), '\s', '', 'g')"
    return f"try_cast(CASE WHEN contains({f}, ',') THEN replace(replace({f}, '.', ''), ',', '.') WHEN length({f}) - length(replace({f}, '.', '')) > 1 OR regexp_matches({f}, '^[0-9]+\\.[0-9]{{3}}$') THEN replace({f}, '.', '') ELSE nullif({f}, '') END AS DECIMAL(18,2))"


def _literals(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def _values(values):
    return "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(v)})" for i, v in enumerate(values)) + ") AS v(id, text))"


@query(f"SELECT id, {sql_price('text')}::DOUBLE AS price FROM (SELECT * FROM {_values(PRICES)} UNION ALL SELECT doc_id + 1000, text FROM documents)")
def price_parse(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), "text")
    return _literals(spark, PRICES).unionAll(docs).select("id", X.parse_price(F.col("text")).cast("double").alias("price"))


_BESIDE = r"(?i)((?:r\$|brl|us\$|usd|\$)\s*[0-9][0-9.,\s]*|\bpor\s+(?:apenas\s+)?[0-9][0-9.,\s]*|[0-9][0-9.,\s]*\s+reais\b)"
_AFTER = r"(?i)\bde\b[^\n]{0,80}?\bpor\b([^\n]{0,80})"


@query(f"WITH v AS (SELECT id, text, nullif(regexp_extract(text, {_q(_AFTER)}, 1), '') AS a, nullif(regexp_extract(text, {_q(_BESIDE)}, 1), '') AS b FROM (SELECT * FROM {_values(STATED)} UNION ALL SELECT doc_id + 1000, text FROM documents)) SELECT id, coalesce({sql_price('a')}, {sql_price('b')})::DOUBLE AS price FROM v")
def stated_price(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), "text")
    return _literals(spark, STATED).unionAll(docs).select("id", X.stated_price(F.col("text")).cast("double").alias("price"))


_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_PART = lambda g: f"regexp_extract(trim(coalesce(url, ''), chr(32) || chr(9) || chr(10) || chr(13)), {_q(_URL)}, {g})"
_CODED = lambda x: f"replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"
_KEY, _VALUE = "string_split(x, '=')[1]", "regexp_replace(x, '^[^=]*=?', '')"
_KEPT = f"array_to_string(list_transform(list_filter(string_split({_PART(4)}, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(url_decode({_KEY})), '^(utm_.*|fbclid|gclid|ref|referrer|source)$')), lambda x: {_CODED(_KEY)} || '=' || {_CODED(_VALUE)}), '&')"
SQL_URL = f"CASE WHEN {_PART(1)} <> '' THEN lower({_PART(1)}) || '://' ELSE '' END || lower({_PART(2)}) || regexp_replace({_PART(3)}, '/+$', '') || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END"


@query(f"SELECT page_id, {SQL_URL} AS canonical FROM pages")
def canonical_urls(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT canonical, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, {SQL_URL} AS canonical FROM pages) GROUP BY canonical HAVING count(*) > 1")
def url_duplicates(spark, sf_dir):
    return canonical_urls(spark, sf_dir).groupBy("canonical").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).filter("n > 1")


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def exact_dedup_native(spark, sf_dir):
    """The first event of each (type, user): a minimum, which is summed before the shuffle, in place of a window."""
    return _read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query(f"WITH h AS (SELECT doc_id, {HASH} AS h FROM documents) SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY h) AS duplicate FROM h")
def replay_dedup(spark, sf_dir):
    h = written(_hashed(spark, sf_dir))
    first = h.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
    return h.join(first, "content_hash").select("doc_id", (F.col("doc_id") > F.col("first")).alias("duplicate"))


@query(None)
def seen_either_key(spark, sf_dir):
    """Events of a user by (type, value rounded): a duplicate of either marks neither."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", F.concat_ws("-", "event_type", F.hour("ts")).alias("native"), F.round("value").cast("string").alias("content"))
    return R.seen_either(e, "native", "content", "user_id", "event_id")


@query(f"WITH {DOCS} SELECT doc_id, list_sort(list_distinct(list_filter(tokens, lambda x: regexp_matches(x, '[0-9]')))) AS models, len(list_distinct(list_filter(tokens, lambda x: NOT list_contains({_list(R.GENERIC)}, x))))::BIGINT AS n_product, len(list_filter(tokens, lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z]'))) > 0 AS strong FROM d")
def near_dup_material(spark, sf_dir):
    d = _sig(spark, sf_dir).withColumns({"title": F.lit(""), "text": F.lit(""), "url": F.lit(None).cast("string"), "price": F.lit(None).cast("decimal(18,2)")})
    return R.near_material(d).select("doc_id", "models", F.size("product").cast("long").alias("n_product"), "strong")


@query(None)
def near_dup_state(spark, sf_dir):
    """Parts as offers that arrive at their line's shipping time, per supplier; a window of 30 days."""
    part, line = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "lineitem")
    m = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("user_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.unix_timestamp("l_shipdate").cast("double").alias("at"),
        F.concat(F.lit("https://x/p/"), "p_partkey").alias("canonical"), F.col("p_retailprice").alias("stated"),
        F.array(F.col("p_brand")).alias("models"), F.split("p_name", " ").alias("product"), F.lit(True).alias("strong"))
    # order of arrival is the shipping time, then the line
    ordered = m.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "seq")).cast("long"))
    return R.near_duplicates(ordered, window=30 * 86400.0)


PROFILE = R.term_weights(INTERESTS, X.alias_groups(ALIASES), ["ing"])
FLAT = dict.fromkeys(["of", "the", "und", "que", "on", "ation"], 1.0)


@query(f"WITH {DOCS}, {sql_stats(FLAT, 'sig', 'd')}, r AS (SELECT doc_id, round({sql_bm25(FLAT, 'sig')}, 6) AS score FROM d, s) SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    scored = R.bm25(_sig(spark, sf_dir), list(FLAT.items()), key="doc_id")
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def _canon(spark, sf_dir):
    return _sig(spark, sf_dir).withColumn("canon", X.canonical_tokens(F.col("sig"), GROUPS))


@query(f"WITH {CANON}, {sql_stats(PROFILE, 'canon', 'c')} SELECT doc_id, round({sql_bm25(PROFILE, 'canon')}, 6) AS score FROM c, s")
def bm25_weighted_users(spark, sf_dir):
    return R.bm25(_canon(spark, sf_dir), list(PROFILE.items()), tokens="canon", key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {DOCS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(sig)) AS term FROM d) GROUP BY term")
def corpus_df(spark, sf_dir):
    return R.corpus_stats(_sig(spark, sf_dir))[1]


_ROLL = f"{DOCS}, r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq, doc_id, len(sig) AS len, sig FROM d)"


@query(f"WITH {_ROLL} SELECT seq, count(*) OVER w AS n, round(avg(len) OVER w, 6) AS avgdl FROM r WINDOW w AS (ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_corpus_stats(spark, sf_dir):
    docs = A.dense(written(_sig(spark, sf_dir).select("doc_id", F.size("sig").alias("len"))), "doc_id")
    return A.rolling_stats(docs, 100).select("seq", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_ROLL}, x AS (SELECT seq, unnest(list_distinct(sig)) AS term FROM r) SELECT seq, term, count(*) OVER (PARTITION BY term ORDER BY seq RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) AS df FROM x")
def rolling_corpus_df(spark, sf_dir):
    seqs = A.dense(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    postings = _sig(spark, sf_dir).select("doc_id", F.array_distinct("sig").alias("terms")).join(seqs, "doc_id").select("seq", F.explode("terms").alias("term"))
    return A.rolling_df(postings, 100).select("seq", "term", "df")


@query(f"WITH {CANON} SELECT doc_id, list_contains(canon, 'the_thing') AS thing, list_contains(canon, 'de_la') AS la, len(canon)::BIGINT AS n_canonical, {sql_covers('canon', X.canonical_py(X.significant_py('ation of'), GROUPS))} AS matches FROM c")
def alias_match(spark, sf_dir):
    c = _canon(spark, sf_dir)
    wanted = X.canonical_py(X.significant_py("ation of"), GROUPS)
    return c.select("doc_id", F.array_contains("canon", "the_thing").alias("thing"), F.array_contains("canon", "de_la").alias("la"), F.size("canon").cast("long").alias("n_canonical"), X.covers(F.col("canon"), wanted).alias("matches"))


@query(f"WITH {CANON} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(canon)) AS term FROM c) GROUP BY term")
def alias_corpus_stats(spark, sf_dir):
    return R.corpus_stats(_canon(spark, sf_dir), "canon")[1]


SHOP = [R.Interest("i1", ["Brand#1", "Brand#2"], 70, max_price=1200.0, attributes={"type": ["PROMO", "STANDARD"]}), R.Interest("i2", ["Brand#3"], 40, min_price=1000.0, excluded=["ECONOMY"])]


def sql_constraints() -> str:
    def any_of(xs):
        return "(" + " OR ".join(sql_covers("sig", X.significant_py(x)) for x in xs) + ")"

    m1, m2 = any_of(SHOP[0].terms), any_of(SHOP[1].terms)
    bad1 = f"({m1} AND p_retailprice > 1200)"
    bad2 = f"(NOT {bad1} AND {m2} AND (p_retailprice < 1000 OR {any_of(['ECONOMY'])}))"
    return f"""SELECT p_partkey, CASE WHEN {bad1} THEN 'price_above_maximum:i1' WHEN {bad2} THEN CASE WHEN p_retailprice < 1000 THEN 'price_below_minimum:i2' ELSE 'excluded_attribute:i2:economy' END END AS violation,
    array_to_string(list_concat(CASE WHEN {m1} THEN ['i1'] ELSE []::VARCHAR[] END, CASE WHEN {m2} AND NOT {bad1} THEN ['i2'] ELSE []::VARCHAR[] END), ',') AS matched,
    {bad1} OR {bad2} OR NOT {m1} OR {any_of(SHOP[0].attributes['type'])} AS proven FROM d"""


_PARTS = f"n AS (SELECT *, {sql_norm('''p_name || ' ' || p_brand || ' ' || p_type''')} AS norm FROM part), t AS (SELECT *, {TOKENS} AS tokens FROM n), d AS (SELECT *, {SIG} AS sig FROM t)"


@query(f"WITH {_PARTS} {sql_constraints()}")
def interest_constraints(spark, sf_dir):
    p = _read(spark, sf_dir, "part").withColumn("norm", X.normalize(F.concat_ws(" ", "p_name", "p_brand", "p_type"))).withColumn("tokens", X.tokens(F.col("norm"))).withColumn("sig", X.significant(F.col("tokens")))
    c = p.select("p_partkey", R.constraints(F.col("sig"), F.col("p_retailprice"), SHOP, []).alias("c"))
    return c.select("p_partkey", "c.violation", F.array_join("c.matched", ",").alias("matched"), "c.proven")


@query("SELECT p_brand, array_to_string(list(p_partkey ORDER BY p_size DESC, p_partkey), ',') AS top FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r <= 5 GROUP BY p_brand")
def interest_context_topk(spark, sf_dir):
    """Top 5 per group: WindowGroupLimit keeps five rows a group and task before the shuffle."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    top = _read(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).filter("r <= 5")
    return top.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "p_partkey"))), lambda x: x["p_partkey"].cast("string")), ",").alias("top"))


USERS = [(1, 4.0, [0]), (2, 2.0, [1]), (3, 1.0, [0, 1])]


def _user(u):
    mine = [INTERESTS[i] for i in u[2]]
    return u[0], u[1], mine, R.term_weights(mine, GROUPS)


def sql_decisions() -> str:
    out = []
    for u in USERS:
        uid, threshold, mine, weights = _user(u)
        hit = " OR ".join(sql_covers("canon", X.canonical_py(X.significant_py(t), GROUPS)) for i in mine for t in i.terms)
        chatter = f"regexp_matches(norm, {_q(R.CHATTER[0])}) OR regexp_matches(norm, {_q(R.CHATTER[1])})"
        top = max(7.0, threshold + 1)
        stage = f"""CASE WHEN NOT regexp_matches(norm, '[a-z0-9]') THEN 'hard_filter' WHEN {chatter} OR regexp_matches(norm, {_q(_RUNS)}) THEN 'hard_filter' WHEN excluded IS NOT NULL THEN 'exclusion'
        WHEN starts_with(rule, 'rule_deny:') THEN 'hard_filter' WHEN dup THEN 'deduplication' WHEN score < {threshold} THEN 'bm25' WHEN NOT ({hit}) THEN 'interest_admission' WHEN score < {top} THEN 'deterministic:below' ELSE 'deterministic:gates' END"""
        stats = sql_stats(weights, "canon", "c").replace("s AS", f"s{uid} AS", 1)
        out.append((stats, f"SELECT {uid}::BIGINT AS user_id, doc_id, {stage} AS stage FROM (SELECT *, {sql_bm25(weights, 'canon')} AS score FROM x, s{uid})"))
    return f"WITH {CANON}, x AS (SELECT *, {sql_exclusion('sig')} AS excluded, {sql_rules('tokens')} AS rule, doc_id > min(doc_id) OVER (PARTITION BY norm) AS dup FROM c), {', '.join(s for s, _ in out)} " + " UNION ALL ".join(q for _, q in out)


@query(sql_decisions())
def user_fanout_decisions(spark, sf_dir):
    """Every document against every user. One pass over the texts makes a small row a document, keyed by the digest of
    its normal text; first copies, corpus statistics and verdicts all come from those. Users are literal
    columns, so the fan-out is an explode of an array of verdicts and no join."""
    users = [_user(u) for u in USERS]
    every = sorted({t for u in users for t in u[3]})
    terms = sorted({t for u in users for i in u[2] for t in i.terms})
    covered = F.array(*[X.covers(F.col("canon"), X.canonical_py(X.significant_py(t), GROUPS)) for t in terms])
    small = R.held(_canon(spark, sf_dir).select(
        "doc_id", F.sha2("norm", 256).alias("h"), R.fixed_reason(F.col("norm"), F.col("text")).alias("fixed"), R.exclusion(F.col("sig"), EXCLUSIONS, ALIASES, F.col("canon")).alias("excluded"),
        R.rule_reason(F.col("tokens"), RULES).alias("rule"), F.size("canon").alias("len"), X.term_counts(F.col("canon"), every).alias("tf"), covered.alias("covered")))
    first = small.groupBy("h").agg(F.min("doc_id").alias("first"))
    c = small.join(first, "h").join(F.broadcast(small.agg(*R.term_stats(len(every)))))  # one row of statistics
    verdicts = []
    for uid, threshold, mine, weights in users:
        score = R.bm25_of(F.col("len"), {t: F.col("tf")[every.index(t)] for t in weights}, weights, F.col("n"), F.col("avgdl"), {t: F.col(f"df{every.index(t)}") for t in weights})
        matched = F.array_compact(F.array(*[F.when(F.col("covered")[terms.index(t)], F.lit(t)) for i in mine for t in i.terms]))
        dup = F.when(F.col("doc_id") > F.col("first"), F.lit("duplicate"))
        none = F.lit(None).cast("string")
        r = R.route(fixed=F.col("fixed"), excluded=F.col("excluded"), rule=F.col("rule"), duplicate=dup, violation=none, exceptional=none, certain=F.lit(True), score=score, threshold=threshold, matched=matched, gates=F.lit(False))
        verdicts.append(F.struct(F.lit(uid).cast("long").alias("user_id"), r.alias("r")))
    stage = F.when(F.col("v.r.stage") != "deterministic", F.col("v.r.stage")).when(F.col("v.r.reason").endswith("below_auto_forward_threshold"), F.lit("deterministic:below")).otherwise(F.lit("deterministic:gates"))
    return c.select("doc_id", F.explode(F.array(*verdicts)).alias("v")).select("v.user_id", "doc_id", stage.alias("stage"))


@query(f"WITH n AS (SELECT p_partkey, p_size, {sql_norm('p_type')} AS norm FROM part) SELECT p_partkey, p_size > 10 AND NOT list_has_any({TOKENS}[1:3], {_list(R.ACCESSORIES)}) AS passes FROM n")
def accessory_gate(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", R.accessory_gate(F.array(F.lit("ssd")), X.tokens(X.normalize(F.col("p_type"))), F.col("p_size") > 10).alias("passes"))


#: The profile, with aliases drawn together as in the documents.
REPLAY = dict.fromkeys(X.canonical_py(["of", "the", "und", "que", "ing"], GROUPS), 1.0)


def sql_replay() -> str:
    return f"""WITH {CANON}, l AS (SELECT c.*, quality = 1 AS relevant, doc_id > min(doc_id) OVER (PARTITION BY norm) AS dup, {sql_rules('tokens')} AS rule, {_CUT} AS cut, len(regexp_extract_all(lower(text), 'https?://')) > 4 AS linked FROM c JOIN labels USING (doc_id)),
    k AS (SELECT *, coalesce(CASE {_PHRASES} ELSE CASE WHEN cut > 50 AND cut <= 100 THEN 'cut' END END, '') <> '' AS exceptional, NOT dup AND NOT linked AND coalesce(NOT starts_with(rule, 'rule_deny:'), true) AND NOT regexp_matches(norm, {_q(_RUNS)}) AND NOT (regexp_matches(norm, {_q(R.CHATTER[0])}) OR regexp_matches(norm, {_q(R.CHATTER[1])})) AND regexp_matches(norm, '[a-z0-9]') AS passed FROM l),
    p AS (SELECT * FROM k WHERE passed), {sql_stats(REPLAY, 'canon', 'p')},
    v AS (SELECT relevant, passed AND (exceptional OR ({sql_bm25(REPLAY, 'canon')}) >= 0.5) AS kept FROM k, s)
    SELECT *, rejection_rate >= 0.9 AND retention_rate >= 0.95 AS passed FROM (SELECT count(*) AS n, sum(CASE WHEN relevant THEN 1 ELSE 0 END)::BIGINT AS relevant, sum(CASE WHEN relevant AND kept THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT relevant AND NOT kept THEN 1 ELSE 0 END)::BIGINT AS rejected,
    round(coalesce(sum(CASE WHEN NOT relevant AND NOT kept THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN NOT relevant THEN 1 ELSE 0 END), 0), 1), 4) AS rejection_rate,
    round(coalesce(sum(CASE WHEN relevant AND kept THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN relevant THEN 1 ELSE 0 END), 0), 1), 4) AS retention_rate FROM v)"""


@query(sql_replay())
def replay_metrics(spark, sf_dir):
    """Offline replay: prefilter, corpus of what passes, exceptional offers kept, BM25 of the profile over canonical tokens
    for the others, confusion counts; one pass over the texts."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant"))
    fine = R.fixed_reason(F.col("norm"), F.col("text")).isNull() & ~F.coalesce(R.rule_reason(F.col("tokens"), RULES).startswith("rule_deny:"), F.lit(False))
    exceptional = R.exceptional_reason(F.col("source"), F.lit(None).cast("int"), F.col("norm")).isNotNull()
    texts = _sig(spark, sf_dir).withColumn("canon", X.canonical_tokens(F.col("sig"), GROUPS))
    small = R.held(texts.select("doc_id", F.sha2("norm", 256).alias("h"), fine.alias("fine"), exceptional.alias("exceptional"), F.size("canon").alias("len"), X.term_counts(F.col("canon"), list(REPLAY)).alias("tf")).join(labels, "doc_id"))
    first = small.groupBy("h").agg(F.min("doc_id").alias("first"))
    judged = small.join(first, "h").withColumn("passed", F.col("fine") & (F.col("doc_id") == F.col("first")))
    stats = judged.agg(*R.term_stats(len(REPLAY), F.col("passed")))
    score = R.bm25_of(F.col("len"), {t: F.col("tf")[i] for i, t in enumerate(REPLAY)}, REPLAY, F.col("n"), F.col("avgdl"), {t: F.col(f"df{i}") for i, t in enumerate(REPLAY)})
    v = judged.join(F.broadcast(stats)).select("relevant", (F.col("passed") & (F.col("exceptional") | (score >= 0.5))).alias("kept"))
    out = v.agg(F.count("*").alias("n"), F.count_if("relevant").alias("relevant"), F.count_if(F.expr("relevant AND kept")).alias("kept"), F.count_if(F.expr("NOT relevant AND NOT kept")).alias("rejected"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), b), F.lit(1.0)), 4)
    out = out.withColumns({"rejection_rate": rate("rejected", F.col("n") - F.col("relevant")), "retention_rate": rate("kept", F.col("relevant"))})
    return out.withColumn("passed", F.expr("rejection_rate >= 0.9 AND retention_rate >= 0.95"))
