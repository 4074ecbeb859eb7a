"""Requests that are accounted, their circuits and caches, and verdicts that follow from an outcome. Latest-per-key folds are
aggregates of a struct, so they are combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a cached value; seconds and rounds of a clarification; bytes of an item of a list.
CACHE_BYTES, CLARIFICATION_SECONDS, ROUNDS, ITEM_BYTES = 64 * 1024, 900, 3, 500
# Locales there are catalogs of; the first is the default.
LOCALES = ["en", "pt-BR"]


def _latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("__top"))
    return top.select(*keys, *(F.col(f"__top.{v}").alias(v) for v in values))


def completed(reserved: DataFrame, completions: DataFrame, key: str, order: list[str], outcome: str, values: list[str]) -> DataFrame:
    """Reservations with what their last completion says; open ones have nulls. Outcomes are cut to 100 characters."""
    last = _latest(completions, [key], order, [outcome, *values])
    return reserved.join(last, key, "left").withColumn(outcome, F.substring(outcome, 1, 100))


def usage(attempts: DataFrame, model: str, stage: str, tokens: list[str]) -> DataFrame:
    """Attempts and sums of tokens (null counts as none) by stage and model."""
    return attempts.groupBy(stage, model).agg(F.count("*").alias("attempts"), *(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in tokens))


def remaining(used: DataFrame, stage: str, caps: dict[str, int], daily: int) -> DataFrame:
    """One row: attempts, what is left of the day, and of each stage with a cap; never below zero."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col(stage) == s, F.col("attempts"))), F.lit(0))
    total = F.coalesce(F.sum("attempts"), F.lit(0))
    return used.agg(total.alias("attempts"), F.greatest(F.lit(0), daily - total).alias("remaining"), *(F.greatest(F.lit(0), cap - of(s)).alias(f"remaining_{s}") for s, cap in caps.items()))


def open_circuits(changes: DataFrame, scope: str, order: list[str], opened: str, until: str, now: Column) -> DataFrame:
    """Scopes whose last change opened them, until a time still to come."""
    return _latest(changes, [scope], order, [opened, until]).filter(F.col(opened) & (F.col(until) > now)).drop(opened)


def cached(puts: DataFrame, keys: list[str], order: list[str], payload: str) -> DataFrame:
    """What a cache gives by key: the first value that was put, if it is a JSON object; values that are too long are
    never put, and others that are no object are evicted when asked for."""
    fits = puts.filter(F.octet_length(payload) <= CACHE_BYTES)
    first = fits.groupBy(*keys).agg(F.min(F.struct(*order, payload)).alias("__first")).select(*keys, F.col(f"__first.{payload}").alias(payload))
    return first.filter(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"))


def locale(value: Column) -> Column:
    """The locale there is a catalog of: the same one, else one of the same language, else the default."""
    v = F.lower(F.replace(F.trim(F.coalesce(value, F.lit(""))), F.lit("_"), F.lit("-")))
    out = F.when(F.lit(False), F.lit(""))
    for name in LOCALES:
        out = out.when(v == name.lower(), F.lit(name))
    for name in LOCALES:
        out = out.when(F.substring_index(v, "-", 1) == name.lower().split("-")[0], F.lit(name))
    return out.otherwise(LOCALES[0])


def ui_language(stored: Column, resolved: Column, hint: Column) -> Column:
    return locale(F.coalesce(stored, resolved, hint))


def catalog_gaps(entries: DataFrame, locale: str, key: str, shape: str) -> DataFrame:
    """Keys that not every locale has, or whose placeholders differ between locales."""
    whole = entries.agg(F.count_distinct(locale).alias("__locales"))
    by_key = entries.groupBy(key).agg(F.count_distinct(locale).alias("n_locales"), F.count_distinct(shape).alias("n_shapes"))
    return by_key.join(F.broadcast(whole)).filter("n_locales < __locales OR n_shapes > 1").drop("__locales")


def retry_verdict(enabled: Column, violation: Column, n_matched: Column, outcome: Column, said: Column, reason: Column) -> Column:
    """Struct of decision and reason when a queued evaluation is tried again: only constraints and interests are asked
    once more, then the evaluation itself."""
    no = lambda why: F.struct(F.lit("discard").alias("decision"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    out = F.when(~enabled, no("gemini_evaluation_disabled")).when(violation.isNotNull(), no(violation)).when(n_matched == 0, no("interest_candidate_miss"))
    return out.when(outcome == "daily_budget", no("retry_daily_budget_exhausted")).otherwise(F.struct(said.alias("decision"), reason.alias("reason")))


def audit_verdict(error: Column, label: Column, reason: Column) -> Column:
    """Struct of decision, shadow decision and reason of an offer below the threshold that is evaluated as a sample."""
    why = F.when(error.isNotNull(), F.concat(F.lit("audit_error:"), error)).otherwise(F.concat(F.lit("below_threshold:"), reason))
    return F.struct(F.lit("discard").alias("decision"), F.when(error.isNull(), label).alias("shadow_decision"), why.alias("reason"))


def delivery_outcome(status: Column, valid: Column, accepted: Column) -> Column:
    """What becomes of a message: sent, to be tried again (no answer, too many, a server's fault, no JSON), or failed."""
    again = status.isNull() | (status == 429) | status.between(500, 599) | ((status < 400) & ~valid)
    return F.when(again, F.lit("retryable")).when((status >= 400) | ~accepted, F.lit("permanent")).otherwise(F.lit("sent"))


def open_clarifications(asked: DataFrame, current: DataFrame, actor: str, base: str, at: str, rounds: str, now: Column) -> DataFrame:
    """Questions that have not expired, of no more than ROUNDS rounds, and whose base is still the current revision."""
    fresh = asked.filter((F.col(at) + F.expr(f"INTERVAL {CLARIFICATION_SECONDS} SECONDS") > now) & (F.col(rounds) <= ROUNDS))
    return fresh.join(current.select(actor, base), [actor, base], "left_semi")


def constraint(raw: Column) -> Column:
    """Struct of minimum and maximum price, attributes as pairs in order of their names, and excluded attributes."""
    x = F.from_json(raw, "struct<min_price:decimal(18,2),max_price:decimal(18,2),attributes:map<string,array<string>>,excluded_attributes:array<string>>")
    pairs = F.array_sort(F.map_entries(F.coalesce(x["attributes"], F.create_map().cast("map<string,array<string>>"))))
    return F.struct(x["min_price"].alias("min_price"), x["max_price"].alias("max_price"), pairs.alias("attributes"), F.coalesce(x["excluded_attributes"], F.array().cast("array<string>")).alias("excluded"))


def string_list(values: Column) -> tuple[Column, Column]:
    """Different values in order, and the fault of the list: an empty or too long value, or none at all."""
    trimmed = F.transform(values, lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
    fault = F.when(F.exists(trimmed, lambda v: v == ""), F.lit("empty_value")).when(F.exists(trimmed, lambda v: F.octet_length(v) > ITEM_BYTES), F.lit("too_long"))
    return F.array_distinct(trimmed), fault.when(F.size(trimmed) == 0, F.lit("empty"))
