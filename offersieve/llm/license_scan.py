"""License scan by ordered signature rules: a keyword prefilter, some two hundred regexes, and interval containment to
settle overlapping detections by priority. DataFrame functions only; no shuffle, so no key can be hot.

Defined results: a null text counts as empty (no words, no labels, score 0); a detection within another one of the same
or a higher priority goes, and of equal intervals and priorities the smaller label stays; base labels always stay;
repeated rows give repeated results; an empty table gives no rows; a very long text is one row's work. Other columns pass
through `scan`, whatever their names; one that is named like a result of it gives way to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.llm.license_rules import AFTER, BEFORE, GAP, GATE, rules

RESULTS = ["c_words", "c_base", "c_first", "c_last", "c_base_labels", "c_spans", "c_score", "c_labels"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the text before A-Z become lower case: the same runs. Java is some 30 times slower with the negated class.
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


def _phrase(words: str) -> str:
    return BEFORE + words.replace(" ", GAP) + AFTER


def _word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(RAW_WORD)).cast("long")


def _detections(low: Column, rule: Column) -> Column:
    """Intervals of one rule: what lies between matches gives their places, as no function returns offsets."""
    pairs = F.arrays_zip(F.split(low, rule["rx"]).alias("gap"), F.regexp_extract_all(low, rule["rx"], F.lit(0)).alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(begin.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull(), F.concat(a["found"], F.array(one))).otherwise(a["found"]).alias("found"))

    return F.aggregate(pairs, start, step)["found"]


def _uncontained(found: Column) -> Column:
    """Detections that no other of their own or a higher priority contains, by one pass in order of start."""
    ordered = F.transform(
        F.sort_array(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("end"), (-d["priority"]).alias("priority"), d["label"].alias("label")))),
        lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("end"), (-d["priority"]).alias("priority"), d["label"].alias("label")),
    )
    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    start = F.struct(*[F.lit(-1).alias(f"top{p}") for p in (1, 2, 3)], none.alias("kept"))

    def step(a: Column, d: Column) -> Column:
        p = d["priority"]
        # topq: the furthest end so far of a detection with a priority of q or more
        top = F.when(p == 3, a["top3"]).when(p == 2, a["top2"]).otherwise(a["top1"])
        tops = [F.when(p >= q, F.greatest(a[f"top{q}"], d["end"])).otherwise(a[f"top{q}"]).alias(f"top{q}") for q in (1, 2, 3)]
        return F.struct(*tops, F.when(top >= d["end"], a["kept"]).otherwise(F.concat(a["kept"], F.array(d))).alias("kept"))

    return F.aggregate(ordered, start, step)["kept"]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with c_words, c_base (places), c_first, c_last, c_base_labels, c_labels, c_score and c_spans (kept detections:
    start, end in code points of the text, priority, label)."""
    others = [c for c in docs.columns if c.lower() not in RESULTS]
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("c_doc"), F.col(text).alias("c_text"))
    t = F.coalesce(F.col("c_text"), F.lit(""))
    loose = F.lower(t)  # only for the gates, which may let more through than they must
    has = lambda *words: F.col("c_loose").contains(words[0]) if len(words) == 1 else has(words[0]) & has(*words[1:])
    base_gate = (has("cc") & has("by") & F.col("c_loose").rlike(f"cc{GAP}by")) | has("general", "public", "license") | has("all", "rights", "reserved")
    gate = has(*GATE[0].split())
    for words in GATE[1:]:
        gate = gate | has(*words.split())
    step = docs.withColumn("c_loose", loose).withColumns({"c_in_base": base_gate, "c_in": gate | base_gate}).drop("c_loose")
    step = step.withColumn("c_low", F.when(F.col("c_in"), F.translate(t, UPPER, LOWER)))
    any_base = "(?:" + "|".join(_phrase(p) for p, _ in BASE) + ")"
    in_base, low = F.col("c_in_base"), F.col("c_low")
    step = step.withColumns({
        "c_words": _word_count(t),
        "c_base": F.coalesce(F.when(in_base, F.regexp_count(low, F.lit(any_base))), F.lit(0)).cast("long"),
    })
    some = F.col("c_base") > 0
    by_keyword: dict[str, list[Column]] = {}
    for label, keyword, pattern, priority in rules():
        by_keyword.setdefault(keyword, []).append(F.struct(F.lit(label).alias("label"), F.lit(pattern).alias("rx"), F.lit(priority).alias("priority")))
    signatures = F.array(*[F.struct(F.array(*map(F.lit, k.split())).alias("words"), F.array(*r).alias("rules")) for k, r in by_keyword.items()])
    near = F.flatten(F.transform(F.filter(signatures, lambda k: F.forall(k["words"], lambda w: low.contains(w))), lambda k: k["rules"]))
    tried = F.filter(near, lambda r: F.regexp(low, r["rx"]))
    step = step.withColumns({
        "c_first": F.when(some, _word_count(F.regexp_extract(low, rf"(?s)^(.*?){any_base}", 1))),
        "c_last": F.when(some, _word_count(F.regexp_extract(low, rf"(?s)^(.*){any_base}", 1))),
        "c_base_labels": F.when(some, F.array(*[F.when(low.rlike(_phrase(p)), F.lit(label)) for p, label in BASE])),
        "c_tried": F.when(F.col("c_in"), tried),
    })
    step = step.withColumn("c_spans", F.when(F.size("c_tried") > 0, _uncontained(F.flatten(F.transform("c_tried", lambda r: _detections(low, r))))))
    base = F.coalesce(F.filter("c_base_labels", lambda x: x.isNotNull()), F.array().cast("array<string>"))
    spans = F.coalesce("c_spans", F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>"))
    top = F.coalesce(F.array_max(F.transform(spans, lambda d: d["priority"])), F.lit(0))
    step = step.withColumns({"c_base_labels": base, "c_spans": spans, "c_score": F.greatest(top / 3.0, F.when(some, F.lit(0.5)).otherwise(F.lit(0.0)))})
    both = F.array_union("c_base_labels", F.transform("c_spans", lambda d: d["label"]))
    step = step.withColumns({
        "c_labels": F.array_join(F.array_sort(F.array_distinct(both)), ","),
        "c_base_labels": F.array_join(F.array_sort("c_base_labels"), ","),
    })
    return step.select(*(F.col(f"c_doc.`{c}`") for c in others), *RESULTS)
