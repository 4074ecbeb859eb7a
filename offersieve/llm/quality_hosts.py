"""Quality rules judged by host: rule failures are counted by domain, the rates are shrunk with an empirical beta prior,
and host verdicts are joined back to documents. DataFrame functions only.

Defined results: a null text counts as empty (no word, so it fails the base rule); a null host is a host of its own; an
empty table gives no rows; repeated rows are judged row by row; a very long text is one row's work; kept columns pass
through `judge` unchanged, whatever their names, but for one named like a result of it, which gives way to the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.llm.common import SPACE, WORD, hold


@dataclass(frozen=True)
class HostRules:
    """Production parameters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    #: A host goes when the shrunk rate of any rule is above this.
    max_host_rate: float = 0.6


RULES = ("short", "repeat", "symbol", "dup_line")


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, which have no columns of such names, with q_words, q_word_chars, q_symbols, q_lines, q_dup_lines and q_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Each array is a column before a lambda refers to it, so that it is built once a row and not once an element.
    step = docs.withColumns({
        "q_w": F.filter(F.split(t, f"{SPACE}+"), lambda w: w != ""),
        "q_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
        "q_word_chars": F.length(F.regexp_replace(t, f"{SPACE}+", "")).cast("long"),
        "q_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
    })
    step = step.withColumns({
        "q_words": F.size("q_w").cast("long"),
        "q_lines": F.size("q_l").cast("long"),
        "q_dup_lines": (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("long"),
        "q_g": F.sort_array(F.transform(
            F.slice("q_w", F.lit(1), F.greatest(F.size("q_w") - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get("q_w", i + 1), F.get("q_w", i + 2)).alias("h"), i.alias("p")),
        )),
    }).drop("q_w", "q_l")
    step = step.withColumn("q_p", F.sort_array(F.filter(
        F.transform("q_g", lambda x, i: F.when((x["h"] == F.get("q_g", i - 1)["h"]) | (x["h"] == F.get("q_g", i + 1)["h"]), x["p"])),
        lambda p: p.isNotNull(),
    ))).drop("q_g")
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("q_p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))
    return step.withColumn("q_repeat_words", covered["n"].cast("long")).drop("q_p")


def failures(rules: HostRules) -> dict[str, Column]:
    """Which rules a document with metrics fails."""
    n = F.col("q_words")
    return {
        "short": n < rules.min_words,
        "repeat": 100 * F.col("q_repeat_words") > rules.max_repeat_percent * n,
        "symbol": 100 * F.col("q_symbols") > rules.max_symbol_percent * F.col("q_word_chars"),
        "dup_line": 100 * F.col("q_dup_lines") > rules.max_dup_line_percent * F.col("q_lines"),
    }


def host_verdicts(metrics: DataFrame, rules: HostRules, host: str = "source") -> DataFrame:
    """A row a host: q_host, n, and host_ok. Counts are pre-aggregated before the shuffle, so a hot host is no hot task.

    The prior of each rule is Beta(a, b) by the method of moments over hosts: the mean is the corpus rate, and the
    spread is what the hosts' rates vary by beyond binomial noise. One row of sums reaches the driver.
    """
    fails = failures(rules)
    hosts = metrics.groupBy(F.col(host).alias("q_host")).agg(F.count("*").alias("n"), *[F.sum(fails[r].cast("long")).alias(f"k_{r}") for r in RULES])
    n = F.col("n").cast("double")
    sums = [F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum(n * n).alias("nn")]
    sums += [x for r in RULES for x in (F.sum(f"k_{r}").alias(f"k_{r}"), F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / n).alias(f"kk_{r}"))]
    total = hosts.agg(*sums).first()
    ok = F.lit(True)
    for r in RULES:
        a, b = beta_prior(total["n"] or 0, total["hosts"], total["nn"] or 0.0, total[f"k_{r}"] or 0, total[f"kk_{r}"] or 0.0)
        ok = ok & ((F.col(f"k_{r}") + a) / (n + (a + b)) <= rules.max_host_rate)
    return hosts.select("q_host", "n", ok.alias("host_ok"))


def beta_prior(n: int, hosts: int, nn: float, k: int, kk: float) -> tuple[float, float]:
    """a, b from sums over hosts of n, n^2, failures and failures^2 / n. The prior weighs 2 to 1,000 documents."""
    if not n or not 0 < k < n:
        return (2.0 * k / n if n else 1.0), (2.0 - 2.0 * k / n if n else 1.0)
    mean = k / n
    within = mean * (1 - mean)
    spread = n - nn / n
    between = (kk - k * k / n - (hosts - 1) * within) / spread if spread > 0 else 0.0
    weight = min(1000.0, max(2.0, within / between - 1)) if between > 0 else 1000.0
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with the metrics, q_base_failed and q_kept.

    Metrics are made once and written, with the kept columns, to the shared folder; host verdicts come from that table
    and are joined back by host. The verdict side has a row a host, so no text is shuffled while it is small; Spark
    decides by its measured size, and splits a hot host's partition otherwise.
    """
    measures = ["q_words", "q_word_chars", "q_symbols", "q_lines", "q_dup_lines", "q_repeat_words"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("q_doc"), F.col(host).alias("q_source"), F.col(text).alias("q_text"))
    made = hold(with_metrics(packed, "q_text").select("q_doc", "q_source", *measures))
    verdicts = host_verdicts(made, rules, "q_source")
    fails = failures(rules)
    base = fails["short"] | fails["repeat"]
    out = made.join(verdicts, F.col("q_source").eqNullSafe(F.col("q_host")), "left")
    verdict = [base.alias("q_base_failed"), (~base & F.coalesce("host_ok", F.lit(True))).alias("q_kept")]
    return out.select(*(F.col(f"q_doc.`{c}`") for c in keep if c.lower() not in {*measures, "q_base_failed", "q_kept"}), *measures, *verdict)
