"""Queries on messages, cards and quota errors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from offersieve.functions import text as X
from offersieve.plans.offers import _literals, _q, _read, _values, sql_norm

QUERIES: dict = {}
ORACLE: dict = {}

# Greetings, and the questions that ask for one's preferences.
GREETINGS = ["oi", "ola", "hello", "hi", "bom dia", "boa tarde", "boa noite", "ajuda", "help", "comandos", "menu"]
ASKS = [
    r"^(?:quais|qual) (?:sao|e) (?:as |o )?(?:minhas? )?preferencias?$",
    r"^qual (?:e )?o (?:meu )?perfil de preferencias?$",
    r"^(?:mostre|mostrar|liste|listar|exiba|exibir|ver) (?:as )?(?:minhas? )?(?:preferencias?|perfil de preferencias?)$",
    r"^(?:minhas? )?preferencias?$",
    r"^what are my preferences$",
    r"^(?:show|list) my preferences$",
]
# What tells a daily limit, in a text without its separators, or as words.
DAILY = ["requestsperday", "perdayperproject", "perprojectperday", "generatedrequestsperday", "requestperday", "dailyquota", "dailylimit", "quotaexhaustedfortheday"]
DAILY_WORDS = r"\b(?:requests?\s+per\s+day|per[- ]day|daily|rpd)\b"

SAID = ["Olá", "Bom dia", "Quais são as minhas preferências", "show my preferences", "/start@bot now", "/HELP", "quero um ssd"]
ERRORS = ["GenerateRequestsPerDayPerProject", "quota: requests per day", "RPD exceeded", "Too many requests per minute", "Daily limit"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_ASKED = " OR ".join(f"regexp_matches(norm, {_q(p)})" for p in ASKS)


@query(f"SELECT id, CASE WHEN norm IN ({', '.join(map(_q, GREETINGS))}) THEN 'help' WHEN {_ASKED} THEN 'preferences' END AS intent, CASE WHEN starts_with(trim(text), '/') THEN lower(regexp_extract(trim(text), '^(/[^ @]*)', 1)) ELSE '' END AS command FROM (SELECT id, text, {sql_norm('text')} AS norm FROM (SELECT * FROM {_values(SAID)} UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations))")
def intent_classification(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    m = _literals(spark, SAID).unionAll(c).withColumn("norm", X.normalize(F.col("text")))
    asked = F.col("norm").rlike("|".join(f"(?:{p})" for p in ASKS))
    text = F.trim("text")
    command = F.when(text.startswith("/"), F.lower(F.regexp_extract(text, r"^(/[^ @]*)", 1))).otherwise(F.lit(""))
    return m.select("id", F.when(F.col("norm").isin(GREETINGS), F.lit("help")).when(asked, F.lit("preferences")).alias("intent"), command.alias("command"))


@query(f"SELECT id, CASE WHEN {' OR '.join(f'contains(compact, {_q(d)})' for d in DAILY)} OR regexp_matches(lower(text), {_q(DAILY_WORDS)}) THEN 'daily' ELSE 'temporary' END AS kind FROM (SELECT id, text, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS compact FROM {_values(ERRORS)})")
def quota_classifier(spark, sf_dir):
    low = F.lower("text")
    compact = F.regexp_replace(low, "[^a-z0-9]+", "")
    return _literals(spark, ERRORS).select("id", F.when(compact.rlike("|".join(DAILY)) | low.rlike(DAILY_WORDS), F.lit("daily")).otherwise(F.lit("temporary")).alias("kind"))


@query("SELECT p_partkey, left(p_name, 500) || chr(10) || 'R$ ' || translate(format('{:,.2f}', round(p_retailprice::DECIMAL(18,4), 2)::DOUBLE), ',.', '.,') AS card FROM part")
def card_text(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.left(F.col("p_name"), F.lit(500)), F.lit("\n"), X.money(F.col("p_retailprice"))).alias("card"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_extract(spark, sf_dir):
    """Title and language of a page; both are fixed shapes, so no parser runs in Python."""
    h = F.col("html")
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([^"]*)"', 1).alias("lang"))
