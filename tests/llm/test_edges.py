"""Every operator and every pipeline stage on odd tables: clashing names, nulls, empty and very long texts, repeated rows, no
rows; and brute-force forms of the language model, the mix's targets and the license rules."""

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offersieve.llm import chat_format, kd_search, language_id, license_scan, line_dedup, mixing, near_dedup, packing, quality_hosts, suffix_dedup
from offersieve.llm.license_rules import rules

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that operators use themselves, inside or in their results.
CLASHES = ["l_spans", "s_spans", "s0", "h", "id", "row", "doc", "had", "n", "k", "cid", "key", "m_size", "m_row", "m_doc", "p_no", "before", "q_words", "q_w", "q_doc", "host_ok", "c_low", "c_in", "c_doc", "c_words", "fold", "pred", "bucket", "slot", "n_tokens", "cell", "rank", "score", "ids", "mask", "left", "lead"]


@pytest.fixture(scope="module")
def plain(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").filter("doc_id < 60")
    rng = np.random.default_rng(12)
    long = " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(150_000))
    odd = [(900, None, "en", "s"), (901, "", None, None), (902, " \n ", "en", "s"), (903, long, "en", "long"), (903, long, "en", "long"), (None, "a b c d e f g", "en", "s"), (None, None, None, None)]
    return docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")).repartition(4).cache()


def _wide(docs):
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "x" * 200_000), (1, 1, "assistant", "x" * 200_000), (2, 0, None, None), (None, None, "assistant", "")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [i / 64, 1.0, -i / 32]) for i in range(50)] + [(3, [3 / 64, 1.0, -3 / 32]), (60, None), (None, [1.0, 2.0, 3.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


ON_DOCS = {
    "packing": lambda d: packing.pack(d).select("doc_id", "n_tokens", "bucket", "bucket_length", "padding"),
    "near": lambda d: near_dedup.near_duplicates(d).select("doc_id", "n_shingles", "component_id", "kept"),
    "language": lambda d: language_id.identify(d).select("doc_id", "held_out", "lang_pred", "score"),
    "lines": lambda d: line_dedup.dedup_lines(d).select("doc_id", "l_kept", "l_passages", F.col("l_spans").cast("string")),
    "licenses": lambda d: license_scan.scan(d).select("doc_id", "c_words", "c_base", "c_labels", F.col("c_spans").cast("string")),
    "hosts": lambda d: quality_hosts.judge(d, keep=tuple(d.columns)).select("doc_id", "q_words", "q_repeat_words", "q_base_failed", "q_kept"),
    "mixing": lambda d: mixing.mix(d, keep=tuple(d.columns)).select("doc_id", "m_size", "m_source_size", "m_target", "m_passes"),
    "suffix": lambda d: suffix_dedup.digest(d),
    "cut": lambda d: suffix_dedup.cut_texts(d, unit="word", width=51, keep_first=True).select("doc_id", "text"),
}


def _rows(df):
    return Counter(map(str, df.collect()))


@pytest.mark.parametrize("name", ON_DOCS)
def test_operators_on_odd_tables(plain, name):
    f = ON_DOCS[name]
    got = _rows(f(plain))
    assert sum(got.values()) == plain.count()
    assert _rows(f(_wide(plain))) == got
    assert f(_wide(plain).limit(0)).count() == 0


def test_chat_and_search_on_odd_tables(turns, vectors):
    read = lambda t: chat_format.read_back(chat_format.format_turns(t))
    find = lambda v: kd_search.top_k(v, v.filter("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score")
    got = read(turns).collect()
    assert sorted(((r.conv_id, r.n_turns, r.loss_chars) for r in got), key=str) == [(1, 3, 400_000), (2, 1, 0), (None, 1, 0)]
    for f, table in ((read, turns), (find, vectors)):
        assert _rows(f(_wide(table))) == _rows(f(table)) and f(_wide(table).limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, plain, name, stage):
    """Extra columns pass through every stage but the last, and change nothing."""
    got, wide = stage(spark, plain, DIR), stage(spark, _wide(plain), DIR)
    if name == "packing":
        assert _rows(wide.drop("batch_id", "slot")) == _rows(got.drop("batch_id", "slot"))
    else:
        assert got.columns == plain.columns and wide.columns == _wide(plain).columns
        assert _rows(wide.select(*plain.columns)) == _rows(got)
        assert all(r[i + 4] == i for r in wide.select(*wide.columns).collect() for i in range(len(CLASHES)))
    assert stage(spark, _wide(plain).limit(0), DIR).count() == 0


def test_language_model_against_a_plain_kneser_ney(spark):
    """Cross-entropy of the chosen language by dictionaries and recursion, from the definition."""
    rng = np.random.default_rng(5)
    alphabet = {"aa": "abcde", "bb": "cdefg", "cc": "aeg"}
    rows = [(i, ", ".join("".join(rng.choice(list(alphabet[x]), int(rng.integers(1, 6)))) for _ in range(12)).title(), x) for i in range(120) for x in [("aa", "bb", "cc")[i % 3]]]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    form = lambda t: "   " + re.sub(r"[^a-z]+", " ", t.lower()).lstrip(" ")
    grams = lambda t: [form(t)[j - 3 : j + 1] for j in range(3, len(form(t)))]
    levels, d = {}, {}
    for x in alphabet:
        level = Counter(g for i, t, lang in rows if lang == x and fold(i) >= 2 for g in grams(t))
        levels[x] = {4: level}
        for k in (3, 2, 1):
            level = levels[x][k] = Counter(g[1:] for g in level)
        for k, level in levels[x].items():
            once, twice = (sum(n == m for n in level.values()) for m in (1, 2))
            d[x, k] = once / (once + 2 * twice) if once and twice else 0.5
    vocabulary = len(set().union(*(levels[x][1] for x in alphabet))) + 1

    @cache
    def p(x, g):
        if not g:
            return 1 / vocabulary
        level = levels[x][len(g)]
        same = [n for h, n in level.items() if h[:-1] == g[:-1]]
        lower = p(x, g[1:])
        return (max(level[g] - d[x, len(g)], 0) + d[x, len(g)] * len(same) * lower) / sum(same) if same else lower

    xe = {i: {x: -sum(math.log(p(x, g)) for g in grams(t)) / len(grams(t)) for x in alphabet} for i, t, _ in rows}
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    for r in out:
        first, second, *_ = sorted(xe[r.doc_id].values())
        assert abs(r.cross_entropy - first) < 1e-4 and abs(r.margin - (second - first)) < 1e-4
        assert second - first < 1e-4 or r.lang_pred == min(xe[r.doc_id], key=xe[r.doc_id].get)


def test_mix_reaches_the_targets_of_a_plain_water_level(spark):
    """Targets by bisection of the level, and what is taken, with null and empty texts, repeated rows and a null source."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{int(rng.integers(0, 3) * rng.integers(0, 3))}") for i in range(900)]
    rows += [(2000 + i, "a b c", None) for i in range(40)] + [rows[5], rows[5], (3000, None, "s0"), (None, "x y", "s4"), (3001, "", "empty")]
    size = lambda t: len((t or "").split())
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    have = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    lo, hi = 0.0, float(sum(have.values()))
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * have[s], mid * weight[s]) for s in sources) < sum(have.values()) else (lo, mid)
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("doc_id", "source")).collect()
    assert Counter((str(r.doc_id), r.m_size) for r in out) == Counter((str(i), size(t)) for i, t, _ in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.m_source_size == have[r.source] and abs(r.m_target - min(3 * have[r.source], hi * weight[r.source])) < 1e-6 and 0 <= r.m_passes <= 3
        taken[r.source] += r.m_size * r.m_passes
        largest[r.source] = max(largest[r.source], r.m_size)
    assert all(abs(taken[r.source] - r.m_target) <= largest[r.source] for r in out)


def test_license_labels_against_all_rules(spark):
    """Every rule tried on every text, without keywords or gates, and containment by comparing all intervals."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("length(text) < 20000").collect()]
    names = ["MIT-No\nAttribution license", "GNU General\nPublic  License, version 2", "Common\nDevelopment and Distribution\tLicense 1.0", "Licensed under the\n * Apache License, Version 2.0", "SPDX-License-Identifier: BSD-3-Clause", "no licence at all", "©copyright 2001", "cc by CC-BY", "ALL RIGHTS\n\nRESERVED"]
    docs += [(10_000 + i, f"{'word ' * i}{x}.\n{y}") for i, (x, y) in enumerate(zip(names, reversed(names), strict=True))]
    python = lambda p: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p), re.ASCII)
    tried = [(label, python(p), priority) for label, _, p, priority in rules()]
    base = [(label, python(license_scan._phrase(p))) for p, label in license_scan.BASE]
    out = {r.doc_id: r.c_labels for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    some = 0
    for i, t in docs:
        low = (t or "").translate(LOWER)
        found = {(m.start(), m.end(), priority, label) for label, rx, priority in tried for m in rx.finditer(low)}
        inside = lambda a, b: b != a and b[0] <= a[0] and a[1] <= b[1] and b[2] >= a[2] and ((b[0], b[1], b[2]) != a[:3] or b[3] < a[3])
        kept = {a[3] for a in found if not any(inside(a, b) for b in found)} | {label for label, rx in base if rx.search(low)}
        assert out[i] == ",".join(sorted(kept)), (i, t[:200])
        some += bool(kept)
    assert some > 20
