"""Operators of the relevance cascade on offers: filters, rules, exclusions, near-duplicate material, BM25, constraints.

An offer is a row with id, source, title, text, price and seq (order of arrival)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offersieve.functions import text as X

# Phrases and words that decide.
CHATTER = [r"\b(bom dia|boa tarde|boa noite|alguem sabe|o que acham|vale a pena|off topic)\b", r"\b(chama no pv|manda dm|grupo de whatsapp|vagas abertas|renda extra)\b"]
EXCEPTIONAL = ["erro de preco", "bug de preco", "preco errado", "menor preco historico", "menor preco da historia", "historical low", "price error"]
ACCESSORIES = ["acessorio", "adaptador", "cabo", "capa", "carregador", "cartucho", "case", "pulseira", "refil", "replacement", "suporte"]
GENERIC = ["a", "agora", "com", "da", "de", "do", "em", "hoje", "oferta", "para", "por", "promocao", "sale"]
HEAT_SOURCE, HEAT_REASON = "pelando", "pelando_temperature:"


@dataclass(frozen=True)
class Rule:
    """A prioritized rule: any of the phrases, and one phrase of every group."""

    rule_id: str
    priority: int
    action: str
    any: list[str] = field(default_factory=list)
    all: list[list[str]] = field(default_factory=list)


@dataclass(frozen=True)
class Interest:
    """What a user looks for, with bounds on price and attributes."""

    interest_id: str
    terms: list[str]
    importance: int = 50
    min_price: float | None = None
    max_price: float | None = None
    attributes: dict[str, list[str]] = field(default_factory=dict)
    excluded: list[str] = field(default_factory=list)


def with_text(offers: DataFrame) -> DataFrame:
    """Adds norm, tokens and sig, each made once."""
    return offers.withColumn("norm", X.normalize(F.concat_ws(" ", "title", "text"))).withColumn("tokens", X.tokens(F.col("norm"))).withColumn("sig", X.significant(F.col("tokens")))


def fixed_reason(norm: Column, raw: Column) -> Column:
    """Why the fixed filter rejects; null if it does not."""
    # a phrase must stand somewhere before it is asked whether it stands as words
    chatter = reduce(or_, [reduce(or_, [norm.contains(p) for p in form[3:-3].split("|")]) & norm.rlike(form) for form in CHATTER])
    return (
        F.when(~norm.rlike("[a-z0-9]"), "empty_text_or_caption").when(chatter, "conversation_or_spam")
        .when(raw.contains("://") & (F.regexp_count(raw, F.lit(r"(?i)https?://")) > 4), "link_spam").when(norm.rlike(r"(.)\1{9,}"), "repeated_character_spam")
    )


def rule_reason(tokens: Column, rules: list[Rule]) -> Column:
    """The first matching rule by priority, as rule_<action>:<id>."""
    return X._with(X.spaced(tokens), lambda x: _rule_of(x, rules))


def _rule_of(spaced: Column, rules: list[Rule]) -> Column:
    out = None
    phrase = lambda p: X.stands_in(spaced, X.normal_py(p).split())
    for r in sorted(rules, key=lambda r: r.priority):
        hit = F.lit(True)
        if r.any:
            hit = F.lit(False)
            for p in r.any:
                hit = hit | phrase(p)
        for group in r.all:
            one = F.lit(False)
            for p in group:
                one = one | phrase(p)
            hit = hit & one
        reason = F.lit(f"rule_{r.action}:{r.rule_id}")
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out if out is not None else F.lit(None).cast("string")


def exclusion(sig: Column, exclusions: list[str], aliases: dict[str, list[str]], canon: Column | None = None) -> Column:
    """The first exclusion that stands in the offer as a phrase, or is an alias whose tokens it covers. `canon`: the
    offer's canonical tokens, where they are there already."""
    groups = X.alias_groups(aliases)
    drawn = X.canonical_tokens(sig, groups) if canon is None else canon
    return X._with(X.spaced(sig), lambda x: _excluded(x, drawn, exclusions, groups))


def _excluded(spaced: Column, drawn: Column, exclusions: list[str], groups: list) -> Column:
    members = {tuple(v) for _, variants in groups for v in variants}
    out = F.lit(None).cast("string")
    for e in reversed(exclusions):
        base = X.significant_py(e)
        hit = X.stands_in(spaced, base) if base else F.lit(False)
        if tuple(base) in members:
            hit = hit | X.covers(drawn, X.canonical_py(base, groups))
        out = F.when(hit, F.lit(e)).otherwise(out)
    return out


def exceptional_reason(source: Column, temperature: Column, norm: Column, threshold: int = 300) -> Column:
    """Heat at its one source, then a phrase, then a discount of more than half."""
    discount = X.stated_discount(norm)
    out = F.when((F.lower(source) == HEAT_SOURCE) & (temperature >= threshold), F.concat(F.lit(HEAT_REASON), temperature.cast("string")))
    for p in EXCEPTIONAL:
        out = out.when(norm.contains(p), F.lit(f"explicit_phrase:{p}"))
    return out.when(discount > 50, F.concat(F.lit("stated_discount:"), F.regexp_replace(discount.cast("string"), r"\.0$", ""), F.lit("%")))


def near_material(offers: DataFrame, url: str = "url") -> DataFrame:
    """Adds canonical, stated, models, product and strong: what near-duplicates are judged by."""
    tokens = F.col("tokens")
    return offers.withColumns({
        "canonical": X.canonical_url(F.col(url)),
        "stated": F.coalesce("price", X.stated_price(F.concat_ws(" ", "title", "text"))),
        "models": F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.rlike("[0-9]")))),
        "product": F.array_sort(F.array_distinct(F.filter(tokens, lambda t: ~t.isin(GENERIC)))),
        "strong": F.exists(tokens, lambda t: t.rlike("[0-9]") & t.rlike("[a-z]")),
    })


def near_duplicate_step(kept: list[dict], row: dict, window: float) -> tuple[str | None, list[dict]]:
    """One arrival against a user's kept fingerprints: the reason to suppress it, or none, and what is kept after it.
    The one definition of the state for batch and stream."""
    kept = [k for k in kept if k["at"] > row["at"] - window]
    price = row["price"]
    same = [k for k in kept if row["url"] and k["url"] == row["url"]]
    known = [k["price"] for k in same if k["price"] is not None]
    if same and (price is None or (known and price >= min(known))):
        return "near_duplicate:url", kept
    if price is not None and row["strong"]:
        mine, models = set(row["product"]), set(row["models"])
        for k in kept:
            if k["price"] is not None and k["strong"] and set(k["models"]) == models and price >= k["price"]:
                theirs = set(k["product"])
                if len(mine & theirs) >= 0.8 * max(len(mine), len(theirs)):
                    return "near_duplicate:product_price", kept
    return None, [*kept, row]


def near_duplicates(material: DataFrame, user: str = "user_id", window: float = 600.0) -> DataFrame:
    """Batch form: per user in order of seq, holding only the window's fingerprints. user_id, seq, reason."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        reasons = []
        pdf = pdf.sort_values("seq")
        for r in pdf.itertuples(index=False):
            row = {"at": r.at, "url": r.canonical, "price": None if r.stated is None or r.stated != r.stated else r.stated, "models": list(r.models), "product": list(r.product), "strong": bool(r.strong)}
            reason, kept = near_duplicate_step(kept, row, window)
            reasons.append(reason)
        return pd.DataFrame({"user_id": pdf[user], "seq": pdf.seq, "reason": reasons})

    cols = [user, "seq", "at", "canonical", "stated", "models", "product", "strong"]
    return material.select(cols).groupBy(user).applyInPandas(run, "user_id long, seq long, reason string")


def seen_either(offers: DataFrame, native: str, content: str, group: str, seq: str = "seq") -> DataFrame:
    """First-seen by native id or content, where a duplicate marks neither: a fold in order of arrival within `group`,
    which must hold all rows that share a key with one another."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, contents, out = set(), set(), []
        pdf = pdf.sort_values("seq")
        for a, b in zip(pdf.native, pdf.content, strict=True):
            dup = a in ids or b in contents
            out.append(dup)
            if not dup:
                ids.add(a)
                contents.add(b)
        return pd.DataFrame({"seq": pdf.seq, "duplicate": out})

    cols = offers.select(F.col(group).alias("part"), F.col(seq).alias("seq"), F.col(native).cast("string").alias("native"), F.col(content).cast("string").alias("content"))
    return cols.groupBy("part").applyInPandas(run, "seq long, duplicate boolean")


def corpus_stats(docs: DataFrame, tokens: str = "sig") -> tuple[DataFrame, DataFrame]:
    """One row (n, avgdl), and term, df. The df shuffle carries one row a term and task."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(tokens)), F.lit(0.0)).alias("avgdl"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return size, df


def held(df: DataFrame) -> DataFrame:
    """Rows that several branches of a plan read, as blocks on disk (made again from the input if an executor is lost).
    An exchange is no help here: each branch prunes it to other columns, so that it is not reused."""
    return df.persist(StorageLevel.DISK_ONLY)


def bm25(docs: DataFrame, query: list[tuple[str, float]], tokens: str = "sig", key: str = "id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score for all documents. One pass over the texts makes a small row of term counts a document; both the corpus
    statistics and the scores come from those, so no text is read twice or shuffled."""
    weights = dict(query)
    small = held(docs.select(key, F.size(tokens).alias("len"), X.term_counts(F.col(tokens), list(weights)).alias("tf")))
    stats = small.agg(*term_stats(len(weights)))
    score = bm25_of(F.col("len"), {t: F.col("tf")[i] for i, t in enumerate(weights)}, weights, F.col("n"), F.col("avgdl"), {t: F.col(f"df{i}") for i, t in enumerate(weights)}, k1, b)
    return small.join(F.broadcast(stats)).select(key, score.alias("score"))  # stats is one row


def term_stats(terms: int, where: Column | None = None) -> list[Column]:
    """Aggregates n, avgdl and df0, df1, ... over rows of len and tf."""
    on = F.lit(True) if where is None else where
    return [F.count_if(on).alias("n"), F.coalesce(F.avg(F.when(on, F.col("len"))), F.lit(0.0)).alias("avgdl"), *[F.count_if(on & (F.col("tf")[i] > 0)).alias(f"df{i}") for i in range(terms)]]


def bm25_of(length: Column, tf: dict[str, Column], weights: dict[str, float], n: Column, avgdl: Column, df: dict[str, Column], k1: float = 1.2, b: float = 0.75) -> Column:
    out = F.lit(0.0)
    for t, w in weights.items():
        f = tf[t].cast("double")
        d = F.greatest(F.lit(0), F.least(df[t], n))
        out = out + F.lit(float(w)) * F.log(1 + (n - d + 0.5) / (d + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * length / F.greatest(avgdl, F.lit(1.0))))
    return F.when((n > 0) & (length > 0), out).otherwise(F.lit(0.0))


def term_weights(interests: list[Interest], groups: list, baseline: list[str] = []) -> dict[str, float]:  # noqa: B006
    """Canonical token to its largest weight: 0.5 + importance / 100, or 1 in the baseline."""
    out: dict[str, float] = {}
    for terms, w in [(baseline, 1.0), *[(i.terms, 0.5 + i.importance / 100) for i in interests]]:
        for term in terms:
            for t in X.canonical_py(X.significant_py(term), groups):
                out[t] = max(out.get(t, 0.0), w)
    return dict(sorted(out.items()))


def constraints(canonical: Column, price: Column, interests: list[Interest], groups: list) -> Column:
    """Struct of violation, matched (ids up to the first violation) and proven, over interests in order of id.

    Three-valued: a missing price or attribute leaves an offer unproven, and only a known one can violate."""
    covers = lambda term: X.covers(canonical, X.canonical_py(X.significant_py(term), groups))

    def any_of(options: list[str]) -> Column:
        out = F.lit(False)
        for o in options:
            out = out | covers(o)
        return out

    steps = []
    for i in sorted(interests, key=lambda i: i.interest_id):
        bad = F.lit(None).cast("string")
        for a in reversed(i.excluded):
            bad = F.when(covers(a), f"excluded_attribute:{i.interest_id}:{X.normal_py(a)}").otherwise(bad)
        if i.max_price is not None:
            bad = F.when(price > i.max_price, f"price_above_maximum:{i.interest_id}").otherwise(bad)
        if i.min_price is not None:
            bad = F.when(price < i.min_price, f"price_below_minimum:{i.interest_id}").otherwise(bad)
        proven = F.lit(True) if i.min_price is None and i.max_price is None else price.isNotNull()
        for options in i.attributes.values():
            proven = proven & any_of(options)
        steps.append(F.when(any_of(i.terms), F.struct(F.lit(i.interest_id).alias("id"), bad.alias("bad"), proven.alias("proven"))))
    met = F.filter(F.array(*steps), lambda s: s.isNotNull())
    start = F.struct(F.lit(None).cast("string").alias("violation"), F.array().cast("array<string>").alias("matched"), F.lit(True).alias("proven"))
    go_on = lambda a, s: F.struct(s["bad"].alias("violation"), F.concat(a["matched"], F.array(s["id"])).alias("matched"), (a["proven"] & s["proven"]).alias("proven"))
    out = F.aggregate(met, start, lambda a, s: F.when(a["violation"].isNotNull(), a).otherwise(go_on(a, s)))
    return F.struct(out["violation"].alias("violation"), out["matched"].alias("matched"), (out["proven"] | out["violation"].isNotNull()).alias("proven"))


def accessory_gate(matched_terms: Column, title_tokens: Column, proven: Column) -> Column:
    """Proven, matched, and not led by an accessory word unless an interest is itself an accessory."""
    words = F.array(*map(F.lit, ACCESSORIES))
    return proven & (F.size(matched_terms) > 0) & (F.arrays_overlap(matched_terms, words) | ~F.arrays_overlap(F.slice(title_tokens, 1, 3), words))


def route(*, fixed: Column, excluded: Column, rule: Column, duplicate: Column, violation: Column, exceptional: Column, certain: Column, score: Column, threshold: float, matched: Column, gates: Column, mode: str = "shadow") -> Column:
    """The ordered cascade, first match wins: struct of decision, stage and reason. The last step is the one without a
    model's verdict, with its reason by priority."""
    top = max(7.0, threshold + 1)
    said = lambda d, s, r: F.struct(F.lit(d).alias("decision"), F.lit(s).alias("stage"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    why = (
        F.when(exceptional.isNotNull() & ~certain, "gemini_evaluation_disabled:uncertain_exceptional").when(score.isNull(), "gemini_evaluation_disabled:bm25_unavailable")
        .when(score < top, "gemini_evaluation_disabled:below_auto_forward_threshold").when(~gates, "gemini_evaluation_disabled:deterministic_gates_failed")
        .otherwise(f"gemini_evaluation_disabled:auto_forward_{'off' if mode == 'off' else 'shadow'}")
    )
    out = (
        F.when(fixed.isNotNull(), said("discard", "hard_filter", fixed)).when(excluded.isNotNull(), said("discard", "exclusion", F.concat(F.lit("explicit_exclusion:"), excluded)))
        .when(rule.startswith("rule_deny:"), said("discard", "hard_filter", rule)).when(duplicate.isNotNull(), said("discard", "deduplication", duplicate))
        .when(violation.isNotNull(), said("discard", "constraints", violation)).when(exceptional.isNotNull() & certain, said("forward", "exceptional", exceptional))
        .when(score < threshold, said("discard", "bm25", "below_threshold"))
    )
    if mode == "live":
        out = out.when((score >= top) & gates, said("forward", "bm25_auto_forward", "above_threshold_with_deterministic_gates"))
    return out.when(F.size(matched) == 0, said("discard", "interest_admission", "interest_candidate_miss")).otherwise(said("discard", "deterministic", why))
