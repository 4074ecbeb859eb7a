"""Every offer against every stored user, where users, interests, aliases, exclusions and rules are tables of any size.

Each test of an offer is whether it holds a set of tokens: a variant of an alias, a search term, the words of a phrase.
Distinct sets are divided into the offers at once (`holding`): needed tokens meet the postings, and an offer holds a set
if it has as many of its tokens as the set. So no plan grows with the number of users, and users and offers are only paired
where something of the user stands in the offer. What decides all other pairs are an offer's class and a user's
settings alone; `decision_counts` takes them from class counts, without making the pairs.

texts: doc_id and words (an offer's tokens, apart by spaces). offers: doc_id, n_sig (significant tokens), title_tokens,
price, fixed, exceptional, replay (a later copy of the same offer).
users: user_id, exceptional_on, threshold, mode. interests: user_id, interest_id, terms, importance, min_price, max_price,
excluded. aliases: user_id, marker, variants (token lists). exclusions: user_id, ord, phrase (tokens). rules: user_id,
priority, rule_id, action, parts (for each group that must match, its phrases as token lists; at least one group).

Aliases draw an offer's tokens together for their user: the tokens of all matching variants go and each matching group's
marker comes once. Scores are BM25 over the canonical tokens of all offers that are no replays, per user.

Defined results: a user without interests and exceptional offers is idle; empty token lists match nothing; a null price
proves nothing; ties among rules go by rule_id, among interests by interest_id; equal rows of a table count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.functions.text import significant_of
from offersieve.operators.lineage import written
from offersieve.operators.relevance import ACCESSORIES

PAIR = ["doc_id", "user_id"]


def key_of(tokens: Column) -> Column:
    """A set of tokens as a string; tokens hold no space."""
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def postings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, token, tf of the wanted tokens; tf counts significant tokens, and is 0 for others that stand in the offer.
    The wanted ones are a written table, whose size Spark knows: where it is small, no other token is shuffled."""
    said = texts.select("doc_id", significant_of(F.col("words")).alias("sig"), F.split("words", " ").alias("tokens"))
    # tokens that are not significant as they stand come behind those that are
    rows = said.select("doc_id", F.size("sig").alias("n_sig"), F.posexplode(F.concat("sig", F.array_except("tokens", "sig"))).alias("at", "token"))
    rows = rows.select("doc_id", "token", (F.col("at") < F.col("n_sig")).cast("int").alias("n"))
    return rows.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("doc_id", "token").agg(F.sum("n").alias("tf"))


def holding(posted: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, key of each set that an offer holds: relational division of the offers' tokens by the sets."""
    of = sets.select("key").distinct().filter("key <> ''").withColumn("token", F.explode(F.split("key", " ")))
    need = of.groupBy("key").agg(F.count("*").alias("need"))
    met = posted.select("doc_id", "token").join(of, "token").groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    return met.join(need, "key").filter("n = need").select("doc_id", "key")


def _canonical(table: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """table with `column` (significant tokens) drawn together by its user's aliases."""
    mine = aliases.groupBy("user_id").agg(F.collect_set(F.struct("marker", "variants")).alias("groups"))
    base = F.col(column)
    hit = lambda v: (F.size(v) > 0) & (F.size(F.array_except(v, base)) == 0)
    groups = F.coalesce("groups", F.array().cast("array<struct<marker:string,variants:array<array<string>>>>"))
    gone = F.flatten(F.flatten(F.transform(groups, lambda g: F.filter(g["variants"], hit))))
    marks = F.transform(F.filter(groups, lambda g: F.exists(g["variants"], hit)), lambda g: g["marker"])
    out = table.join(mine, "user_id", "left").withColumns({"gone": gone, "marks": F.array_distinct(marks)})
    return out.withColumn(column, F.array_distinct(F.concat(F.filter(base, lambda t: ~F.array_contains("gone", t)), "marks"))).drop("groups", "gone", "marks")


class Preferences:
    """The users' tables in the forms that joins need."""

    def __init__(self, interests: DataFrame, aliases: DataFrame, exclusions: DataFrame, rules: DataFrame) -> None:
        self.interests = written(interests.dropDuplicates(["user_id", "interest_id"]))
        self.variants = written(aliases.select("user_id", "marker", F.explode("variants").alias("tokens")).filter(F.size("tokens") > 0).withColumn("key", key_of(F.col("tokens"))).distinct())
        term = lambda kind, c: self.interests.select("user_id", "interest_id", F.lit(kind).alias("kind"), F.posexplode(c).alias("no", "tokens"))
        terms = term("term", "terms").union(term("excluded", "excluded"))
        member = self.variants.select("user_id", F.col("key").alias("member")).distinct()
        outs = exclusions.withColumn("member", key_of(F.col("phrase")))
        outs = outs.join(member, ["user_id", "member"], "left_semi").select("user_id", F.lit(None).cast("string").alias("interest_id"), F.lit("out").alias("kind"), F.col("ord").alias("no"), F.col("phrase").alias("tokens"))
        reqs = _canonical(terms.union(outs).withColumn("said", F.col("tokens")), aliases, "tokens")
        self.reqs = written(reqs.filter(F.size("tokens") > 0).withColumn("key", key_of(F.col("tokens"))))
        weight = self.interests.select("user_id", "interest_id", (F.lit(0.5) + F.col("importance") / 100).alias("w"))
        self.weights = self.reqs.filter("kind = 'term'").join(weight, ["user_id", "interest_id"]).select("user_id", F.explode("tokens").alias("token"), "w").groupBy("user_id", "token").agg(F.max("w").alias("w"))
        parts = rules.select("user_id", "priority", "rule_id", "action", F.size("parts").alias("need"), F.posexplode("parts").alias("part", "phrases"))
        self.phrases = written(
            exclusions.select("user_id", F.lit("out").alias("kind"), "ord", F.lit(None).cast("int").alias("priority"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("action"), F.lit(1).alias("need"), F.lit(0).alias("part"), F.col("phrase").alias("tokens"))
            .union(parts.select("user_id", F.lit("rule"), F.lit(None).cast("int"), "priority", "rule_id", "action", "need", "part", F.explode("phrases")))
            .filter(F.size("tokens") > 0).withColumns({"key": key_of(F.col("tokens")), "words": F.array_join("tokens", " ")})
        )

    def sets(self) -> DataFrame:
        return self.variants.select("key").union(self.reqs.select("key")).union(self.phrases.select("key")).distinct()

    def wanted(self) -> DataFrame:
        tokens = self.sets().select(F.explode(F.split("key", " ")).alias("token"))
        return tokens.union(self.variants.select(F.explode("tokens"))).union(self.weights.select("token")).distinct()


def drawn_together(found: DataFrame, prefs: Preferences) -> DataFrame:
    """doc_id, user_id, gone, marks: where aliases of a user match an offer."""
    hits = found.join(prefs.variants.select("user_id", "marker", "tokens", "key"), "key")
    return hits.groupBy(*PAIR).agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("gone"), F.collect_set("marker").alias("marks"))


def matching(found: DataFrame, posted: DataFrame, drawn: DataFrame, prefs: Preferences) -> DataFrame:
    """doc_id, user_id, interest_id, kind, no, said of the requirements that an offer's canonical tokens meet."""
    cols = [*PAIR, "interest_id", "kind", "no", "said"]
    plain = found.join(prefs.reqs, "key").join(drawn, PAIR, "left")
    lost = F.exists("tokens", lambda t: F.array_contains("gone", t) & ~F.array_contains("marks", t))
    plain = plain.filter(F.col("gone").isNull() | ~lost).select(cols)
    marked = drawn.join(prefs.reqs, "user_id").filter(F.arrays_overlap("marks", "tokens")).withColumn("token", F.explode("tokens"))
    have = marked.join(posted.filter("tf > 0").select("doc_id", "token", F.lit(True).alias("there")), ["doc_id", "token"], "left")
    ok = F.array_contains("marks", F.col("token")) | (F.coalesce("there", F.lit(False)) & ~F.array_contains("gone", F.col("token")))
    marked = have.groupBy(*cols, F.size("tokens").alias("need")).agg(F.count_if(ok).alias("n")).filter("n = need").select(cols)
    return plain.union(marked).distinct()


def phrases_standing(found: DataFrame, texts: DataFrame, prefs: Preferences) -> DataFrame:
    """doc_id, kind, words of phrases that stand in an offer: in its significant tokens for exclusions, in all for rules. A
    text meets its likely phrases as one list, of at most what all users say in tokens that the offer holds."""
    said = prefs.phrases.select("kind", "key", F.col("words").alias("phrase")).distinct()
    near = found.join(said, "key").groupBy("doc_id").agg(F.collect_set(F.struct("kind", F.col("phrase").alias("words"))).alias("near"))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    asked = F.exists("near", lambda p: p["kind"] == "out")
    met = texts.join(near, "doc_id").withColumn("sig_text", F.when(asked, spaced(F.array_join(significant_of(F.col("words")), " ")))).withColumn("token_text", spaced(F.col("words")))
    stands = lambda p: F.when(p["kind"] == "out", F.col("sig_text")).otherwise(F.col("token_text")).contains(spaced(p["words"]))
    return met.select("doc_id", F.explode(F.filter("near", stands)).alias("p")).select("doc_id", "p.kind", "p.words")


def scores(offers: DataFrame, posted: DataFrame, drawn: DataFrame, prefs: Preferences, users: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, user_id, score where any weighted token of the user stands: BM25 over what the corpus is for that user."""
    corpus = offers.filter("NOT replay").select("doc_id", F.col("n_sig").alias("len"))
    alive = posted.filter("tf > 0").join(corpus.select("doc_id"), "doc_id", "left_semi")
    drawn = drawn.join(corpus.select("doc_id"), "doc_id", "left_semi")
    plain = alive.join(prefs.weights, "token").join(drawn.select(*PAIR, "gone"), PAIR, "left").filter(F.col("gone").isNull() | ~F.array_contains("gone", F.col("token"))).select(*PAIR, "token", "tf", "w")
    marks = drawn.select(*PAIR, F.explode("marks").alias("token")).join(prefs.weights, ["user_id", "token"]).select(*PAIR, "token", F.lit(1).cast("long").alias("tf"), "w")
    rows = written(plain.union(marks).groupBy(*PAIR, "token", "w").agg(F.sum("tf").alias("tf")))
    df = rows.groupBy("user_id", "token").agg(F.count("*").alias("df"))
    lost = drawn.select(*PAIR, F.explode("gone").alias("token")).join(alive, ["doc_id", "token"]).groupBy(*PAIR).agg(F.sum("tf").alias("lost"))
    moved = written(drawn.select(*PAIR, F.size("marks").alias("more")).join(lost, PAIR, "left").select(*PAIR, (F.col("more") - F.coalesce("lost", F.lit(0))).alias("moved")))
    whole = corpus.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    per_user = users.select("user_id").join(moved.groupBy("user_id").agg(F.sum("moved").alias("all_moved")), "user_id", "left").join(F.broadcast(whole))  # one row
    stats = per_user.select("user_id", "n", ((F.col("total") + F.coalesce("all_moved", F.lit(0))) / F.greatest("n", F.lit(1))).alias("avgdl"))
    f, n, d = F.col("tf").cast("double"), F.col("n"), F.col("df")
    size = F.col("len") + F.coalesce("moved", F.lit(0))
    part = F.col("w") * F.log(1 + (n - d + 0.5) / (d + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * size / F.greatest("avgdl", F.lit(1.0))))
    joined = rows.join(df, ["user_id", "token"]).join(stats, "user_id").join(corpus, "doc_id").join(moved, PAIR, "left")
    return joined.groupBy(*PAIR).agg(F.sum(part).alias("score"))


def _violation(price: Column) -> Column:
    """Of one interest that may match: why the offer violates it, or null."""
    id_ = F.col("interest_id")
    return F.when(price < F.col("min_price"), F.concat(F.lit("price_below_minimum:"), id_)).when(price > F.col("max_price"), F.concat(F.lit("price_above_maximum:"), id_)).when(F.col("barred").isNotNull(), F.concat(F.lit("excluded_attribute:"), id_, F.lit(":"), F.col("barred")))


def routed(fixed: Column, excluded: Column, rule: Column, replay: Column, idle: Column, violation: Column, exceptional: Column, on: Column, may: Column, proven: Column, score: Column, threshold: Column, matched: Column, gates: Column, mode: Column) -> Column:
    """stage, reason: the first that applies of idle, replay, fixed filter, exclusion, rule, constraint, exceptional,
    score below the threshold, live forwarding, no interest; then why nothing is forwarded without a model."""
    said = lambda stage, reason: F.struct(F.lit(stage).alias("stage"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    uncertain = on & exceptional.isNotNull() & may & ~proven
    scored = F.when(~uncertain, F.coalesce(score, F.lit(0.0)))
    top = F.greatest(F.lit(7.0), threshold + 1)
    why = (
        F.when(uncertain, "uncertain_exceptional").when(scored < top, "below_auto_forward_threshold")
        .when(~gates, "deterministic_gates_failed").otherwise(F.concat(F.lit("auto_forward_"), F.when(mode == "off", "off").otherwise("shadow")))
    )
    return (
        F.when(idle, said("idle", "no_interests_and_exceptional_disabled")).when(replay, said("deduplication", "native_replay"))
        .when(fixed.isNotNull(), said("hard_filter", fixed)).when(excluded.isNotNull(), said("exclusion", F.concat(F.lit("explicit_exclusion:"), excluded)))
        .when(rule.startswith("rule_deny:"), said("hard_filter", rule)).when(violation.isNotNull(), said("constraints", violation))
        .when(on & exceptional.isNotNull() & ~uncertain, said("exceptional", exceptional)).when(scored < threshold, said("bm25", "below_threshold"))
        .when((scored >= top) & gates & (mode == "live"), said("bm25_auto_forward", "above_threshold_with_deterministic_gates"))
        .when(~matched, said("interest_admission", "interest_candidate_miss")).otherwise(said("deterministic", F.concat(F.lit("gemini_evaluation_disabled:"), why)))
    )


def _idle(users: DataFrame, interests: DataFrame) -> DataFrame:
    have = interests.select("user_id", F.lit(True).alias("has")).distinct()
    return users.dropDuplicates(["user_id"]).join(have, "user_id", "left").withColumn("idle", F.col("has").isNull() & ~F.col("exceptional_on")).drop("has")


def decisions(texts: DataFrame, offers: DataFrame, users: DataFrame, interests: DataFrame, aliases: DataFrame, exclusions: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, user_id, stage, reason, score of every pair in which anything of the user stands in the offer."""
    prefs = Preferences(interests, aliases, exclusions, rules)
    posted = written(postings(texts, written(prefs.wanted())))
    found = written(holding(posted, prefs.sets()))
    drawn = written(drawn_together(found, prefs))
    met = written(matching(found, posted, drawn, prefs))
    stood = written(phrases_standing(found, texts, prefs).join(prefs.phrases, ["kind", "words"]))
    ruled = stood.filter("kind = 'rule'").groupBy(*PAIR, "priority", "rule_id", "action", "need").agg(F.countDistinct("part").alias("n")).filter("n = need")
    ruled = ruled.groupBy(*PAIR).agg(F.min(F.struct("priority", "rule_id", "action")).alias("r")).select(*PAIR, F.concat(F.lit("rule_"), F.col("r.action"), F.lit(":"), F.col("r.rule_id")).alias("rule"))
    outs = stood.filter("kind = 'out'").select(*PAIR, "ord", "words").union(met.filter("kind = 'out'").select(*PAIR, "no", F.array_join("said", " ")))
    outs = outs.groupBy(*PAIR).agg(F.min(F.struct("ord", "words")).alias("o")).select(*PAIR, F.col("o.words").alias("excluded"))
    barred = met.filter("kind = 'excluded'").groupBy(*PAIR, "interest_id").agg(F.min(F.struct("no", F.array_join("said", " ").alias("t")))["t"].alias("barred"))
    terms = met.filter("kind = 'term'").groupBy(*PAIR, "interest_id").agg(F.max(F.arrays_overlap("said", F.array(*map(F.lit, ACCESSORIES)))).alias("accessory"))
    priced = terms.join(barred, [*PAIR, "interest_id"], "left").join(prefs.interests.select("user_id", "interest_id", "min_price", "max_price"), ["user_id", "interest_id"]).join(offers.select("doc_id", "price"), "doc_id")
    bounded = F.col("min_price").isNotNull() | F.col("max_price").isNotNull()
    priced = priced.withColumns({"bad": _violation(F.col("price")), "sure": ~bounded | F.col("price").isNotNull()})
    matched = priced.groupBy(*PAIR).agg(F.min(F.when(F.col("bad").isNotNull(), F.struct("interest_id", "bad"))).alias("b"), F.min("sure").alias("sure"), F.max("accessory").alias("accessory")).select(*PAIR, F.col("b.bad").alias("violation"), "sure", "accessory", F.lit(True).alias("matched"))
    scored = scores(offers, posted, drawn, prefs, users)
    pairs = outs.select(PAIR).union(ruled.select(PAIR)).union(matched.select(PAIR)).union(scored.select(PAIR)).distinct()
    for part in (outs, ruled, matched, scored):
        pairs = pairs.join(part, PAIR, "left")
    led = F.arrays_overlap(F.slice("title_tokens", 1, 3), F.array(*map(F.lit, ACCESSORIES)))
    whole = pairs.join(offers.select("doc_id", "fixed", "exceptional", "replay", led.alias("led")), "doc_id").join(_idle(users, prefs.interests), "user_id")
    may, sure = F.coalesce("matched", F.lit(False)), F.coalesce("sure", F.lit(True))
    gates = may & sure & (F.coalesce("accessory", F.lit(False)) | ~F.col("led"))
    r = routed(F.col("fixed"), F.col("excluded"), F.col("rule"), F.col("replay"), F.col("idle"), F.col("violation"), F.col("exceptional"), F.col("exceptional_on"), may, sure, F.col("score"), F.col("threshold"), may, gates, F.col("mode"))
    return whole.select(*PAIR, "fixed", "exceptional", "replay", "score", r.alias("r")).select(*PAIR, "fixed", "exceptional", "replay", "r.stage", "r.reason", "score")


def decision_counts(offers: DataFrame, users: DataFrame, made: DataFrame, interests: DataFrame) -> DataFrame:
    """user_id, stage, reason, n over all pairs: those of `made` (from decisions) as they are; for the others, the offers
    of each class (replay, fixed, exceptional) that the user has no decision on, under the user's settings."""
    kinds = ["fixed", "exceptional", "replay"]
    class_of = F.struct(*kinds)
    classes = offers.groupBy(class_of.alias("c")).agg(F.count("*").alias("all"))
    seen = made.groupBy("user_id", class_of.alias("c")).agg(F.count("*").alias("seen"))
    # Classes are few: reasons of the fixed filter and of exceptional offers. Each user gets them as one array.
    every = classes.agg(F.collect_list(F.struct("c", "all")).alias("classes"))
    rest = _idle(users, interests).join(F.broadcast(every)).withColumn("k", F.explode("classes")).select("user_id", "idle", "exceptional_on", "threshold", "mode", "k.c", "k.all")
    seen = seen.select(F.col("user_id").alias("u"), F.col("c").alias("k"), "seen")
    rest = rest.join(seen, (F.col("user_id") == F.col("u")) & F.col("c").eqNullSafe(F.col("k")), "left")
    none, no = F.lit(None).cast("string"), F.lit(False)
    r = routed(F.col("c.fixed"), none, none, F.col("c.replay"), F.col("idle"), none, F.col("c.exceptional"), F.col("exceptional_on"), no, F.lit(True), F.lit(0.0), F.col("threshold"), no, no, F.col("mode"))
    rest = rest.select("user_id", r.alias("r"), (F.col("all") - F.coalesce("seen", F.lit(0))).alias("n")).select("user_id", "r.stage", "r.reason", "n")
    both = made.select("user_id", "stage", "reason", F.lit(1).cast("long").alias("n")).union(rest)
    return both.groupBy("user_id", "stage", "reason").agg(F.sum("n").alias("n")).filter("n > 0")
