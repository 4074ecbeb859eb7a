"""Corpus operators against brute force on small fixtures with nulls, empty and repeated rows, ties and clashing names."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offersieve.llm import chat_format, common, kd_search, language_id, license_scan, line_dedup, mixing, near_dedup, packing, quality_hosts, shingles, suffix_dedup

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long"
ODD = [(900, None), (901, ""), (902, " \n "), (903, "a b"), (904, "de " * 400), (905, "x" * 900), (906, "All  RIGHTS-reserved cc-by CC by. general Public\nlicense")]


@pytest.fixture(scope="module")
def rows(spark):
    got = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    return [*got, *ODD, (7, dict(got)[7]), (None, got[3][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With a column of a name that operators use themselves."""
    return spark.createDataFrame([(i, t, None if (i or 0) % 7 == 0 else "en", None if i == 900 else f"s{(i or 0) % 3}", 1, 5) for i, t in rows], SCHEMA)


def test_quality(docs, rows):
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        hit = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    out = quality_hosts.judge(docs).collect()
    want = Counter((str(i), *brute(t)) for i, t in rows)
    assert Counter((str(r.doc_id), r.q_words, r.q_word_chars, r.q_symbols, r.q_dup_lines, r.q_repeat_words) for r in out) == want
    assert all(r.q_base_failed == (r.q_words < 50 or 100 * r.q_repeat_words > 50 * r.q_words) and not (r.q_base_failed and r.q_kept) for r in out)
    assert quality_hosts.judge(docs.limit(0)).count() == 0


def test_license(docs, rows):
    phrases = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = sorted((i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))

    out = license_scan.scan(docs.drop("row")).collect()
    assert Counter((str(r.doc_id), r.c_words, r.c_base, r.c_first, r.c_last, r.c_base_labels) for r in out) == Counter((str(i), *brute(t)) for i, t in rows)
    assert all(set(filter(None, r.c_base_labels.split(","))) <= set(r.c_labels.split(",")) and 0 <= r.c_score <= 1 for r in out)


def test_license_containment(spark):
    text = "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: MIT"
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.c_labels == "apache-2.0,mit"


def _sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("small", [near_dedup.SMALL, 3])
def test_near_dedup(docs, rows, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    sets, up = _sets(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
            up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    want = Counter((str(d), len(sets[i]), str(min((x for x in ids[find(i)] if x is not None), default=None)) if sets[i] else str(d)) for i, (d, _) in enumerate(rows))
    assert Counter((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup.near_duplicates(docs).collect()) == want


@pytest.mark.parametrize("how", [{}, {"hot": 1}, {"chunk": 3000}])
def test_suffix_dedup(docs, rows, how):
    n = Counter(b[j : j + 400] for _, t in rows for b in [(t or "").encode()] for j in range(len(b) - 399))

    def brute(b):
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if n[b[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        return len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()

    got = Counter((str(r[0]), *r[1:]) for r in suffix_dedup.digest(docs, **how).collect())
    assert got == Counter((str(i), *brute((t or "").encode())) for i, t in rows)


def test_texts_apart_that_a_polynomial_joins(spark):
    turn = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = turn.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, turn[:512]), (2, other[:512]), (3, turn), (4, other)], "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in near_dedup.near_duplicates(docs).collect())
    blocks = spark.createDataFrame([(1, "".join(f"{x}" * 2 for x in turn[:600])), (2, "".join(f"{x}" * 2 for x in other[:600]))], "doc_id long, text string")
    n = Counter(t[i : i + 400] for (_, t) in blocks.collect() for i in range(len(t) - 399))
    want = {i: sum(any(n[t[j : j + 400]] > 1 for j in range(max(0, x - 399), min(x, len(t) - 400) + 1)) for x in range(len(t))) for i, t in blocks.collect()}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.digest(blocks).collect()} == want


@pytest.mark.parametrize("block", [1, 2, 3, 4, 8, 12])
def test_hashes_tell_orders_of_blocks_apart(block):
    """Two words over two blocks in the order of Thue and Morse, of bytes and of words, at every length."""
    order = np.array([bin(i).count("1") % 2 for i in range(512)])
    for grams, alphabet in ((shingles.byte_grams, np.arange(1, 1 + 2 * block, dtype=np.uint8)), (shingles.word_grams, shingles.mix64(np.arange(2 * block, dtype=np.uint64)))):
        blocks = alphabet.reshape(2, block).copy()
        blocks[1, 1:] = blocks[0, 1:]  # the blocks differ in their first symbol only
        tail = blocks[0, -7:]
        one, two = (np.concatenate([*blocks[x], tail]) for x in (order, 1 - order))
        for points in (shingles.ANCHOR, shingles.WHOLE):
            a, b = (shingles.Rolling(grams(t), 8 if t.dtype == np.uint8 else 4, points) for t in (one, two))
            for n in range(16, len(one), block):
                same = (np.lib.stride_tricks.sliding_window_view(one, n) == np.lib.stride_tricks.sliding_window_view(two, n)).all(axis=1)
                assert ((a.all(n) == b.all(n)) == same).all()


@pytest.mark.parametrize("unit,width", [("byte", 400), ("word", 51)])
@pytest.mark.parametrize("keep_first", [False, True])
def test_different_texts_of_blocks_stay(spark, unit, width, keep_first):
    """The first 200 symbols are common, then come sixteen blocks in the order of Thue and Morse, and 65 common symbols."""
    order = [bin(i).count("1") % 2 for i in range(16)]
    rng = np.random.default_rng(3)
    ends = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, n)) for n in (200, 65)]
    rows = []
    for i, turn in enumerate((order, [1 - x for x in order])):
        middle = "".join("}8"[x] + "n_W[:'K" for x in turn)
        text = ends[0] + "n_W[:'K" + middle + ends[1]
        rows.append((i, text if unit == "byte" else " ".join(text[180:][:85])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.cut_texts(docs, unit=unit, width=width, keep_first=keep_first).collect()}
    size = (lambda t: len(t)) if unit == "byte" else (lambda t: len(t.split()))
    symbols = [list(t) if unit == "byte" else t.split() for _, t in rows]
    common = [k for k in range(len(symbols[0]) - width + 1) if symbols[0][k : k + width] == symbols[1][k : k + width]]
    assert not common and [size(got[i]) for i in (0, 1)] == [len(s) for s in symbols]
    if unit == "byte" and not keep_first:
        assert {r.n_removed for r in suffix_dedup.digest(docs).collect()} == {0}


@pytest.mark.parametrize("how", [{}, {"hot": 1}, {"unit": "word", "width": 51}, {"unit": "word", "width": 8, "hot": 1}])
def test_suffix_dedup_keeps_the_first(docs, rows, how):
    """Spans of what comes again, in order of (doc_id, row); repeated rows lose what the first of them loses."""
    width, word = how.get("width", 400), how.get("unit") == "word"
    keyed = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", suffix_dedup.row_hash("doc_id", "text").alias("h")).collect()}
    of = lambda t: (t or "").encode().split() if word else (t or "").encode()
    twice = Counter(rows)
    seen, want = set(), {}
    for d, t in sorted(keyed, key=lambda r: (r[0] is None, r[0] or 0, keyed[r])):
        s = of(t)
        gone = bytearray(len(s))
        for j in range(len(s) - width + 1):
            w = tuple(s[j : j + width])
            if w in seen:
                gone[j : j + width] = b"\1" * width
            seen.add(w)
        assert twice[(d, t)] <= 2
        if any(gone):
            want[(d, keyed[(d, t)])] = [list(m.span()) for m in re.finditer(b"\1+", bytes(gone))]
    got = {(r.id, r.row): suffix_dedup.merged([s.asDict() for s in r.spans]) for r in suffix_dedup.repeats(docs, keep_first=True, **how).collect()}
    first = {k: v for k, v in got.items() if k in want or k not in {(d, keyed[(d, t)]) for (d, t), n in twice.items() if n > 1}}
    assert first == want


@pytest.mark.parametrize("keep_first", [False, True])
def test_suffix_dedup_deals_hot_keys(docs, monkeypatch, keep_first):
    """Salted or not, the same stretches go."""

    def got():
        return sorted((str(r.id), r.row, str(r.spans)) for r in suffix_dedup.repeats(docs, width=60, keep_first=keep_first).collect())

    want = got()
    monkeypatch.setattr(common, "KEY_ROWS", 1)
    assert want and got() == want


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "KEY_ROWS", 10)
    left = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 3 != 0).cast("int")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 5")
    joined = common.salted_join(left, right, right, ["k"], "n", 1000, ["id"])
    assert joined.columns == ["k", "id", "n"]
    assert sorted(r.id for r in joined.collect()) == sorted(r.id for r in left.filter("k <> 5").collect())


def test_suffix_dedup_counts_words_of_passages(docs, rows):
    n = Counter(tuple(w[j : j + 51]) for _, t in rows for w in [(t or "").encode().split()] for j in range(len(w) - 50))

    def brute(w):
        gone = bytearray(len(w))
        for j in range(len(w) - 50):
            if n[tuple(w[j : j + 51])] > 1:
                gone[j : j + 51] = b"\1" * 51
        return sum(gone)

    got = Counter((str(r.doc_id), r.passage_words) for r in suffix_dedup.digest(docs, passages=51).collect())
    assert got == Counter((str(i), brute((t or "").encode().split())) for i, t in rows)


def test_suffix_dedup_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5)) for _ in range(n))
    passage, rows = words(200), []
    for i in range(3):
        rows.append((i, f"{words(1500 + i)} {passage} {words(900)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [(r.n_removed >= len(passage), r.n_spans, r.passage_words) for r in suffix_dedup.digest(docs, passages=51).collect()] == [(True, 1, 200)] * 3


@pytest.mark.parametrize("kind", ["line", "paragraph"])
def test_line_dedup(docs, rows, kind):
    """By a plain loop over all occurrences in order: lines that came before, and runs of sentences that did."""
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x.translate(LOWER))
    cut = lambda t: [(m.start(), m.end()) for m in re.finditer(r"[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+", t)]
    seen, want = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        gone, run, free, passages, at = [], 0, [], [], 0
        for line in re.split(r"\n" if kind == "line" else r"\n[ \t\r]*\n", t or ""):
            at = (t or "").index(line, at)
            if whole := tuple(words(line)):
                line_again = whole in seen
                seen.add(whole)
                if line_again:
                    gone.append((at, at + len(line)))
                parts = [(a, b) for a, b in cut(line) if words(line[a:b])]
                for a, b in parts if len(parts) > 1 else [(0, len(line))]:
                    form = tuple(words(line[a:b]))
                    again = form in seen if len(parts) > 1 else line_again
                    seen.add(form)
                    if again:
                        run += len(form)
                        free += [(at + a, at + b)] if len(parts) > 1 and not line_again else []
                    else:
                        passages.append((run, free))
                        run, free = 0, []
            at += len(line)
        passages.append((run, free))
        long = [(n, f) for n, f in passages if n >= 25]
        want[(d, t)] = (sorted({*gone, *(x for _, f in long for x in f)}), len(long), sum(n for n, _ in long))
    wide = docs.withColumnRenamed("row", "l_row").withColumn("L_Spans", F.lit(1)).withColumn("doc", F.lit(2))
    out = line_dedup.dedup_lines(wide, kind=kind)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "l_row", "doc", "l_spans", "l_passages", "l_passage_words", "l_kept"]
    out = out.collect()
    got = Counter((str(r.doc_id), str([tuple(s) for s in r.l_spans]), r.l_passages, r.l_passage_words) for r in out)
    assert got == Counter((str(d), str(want[(d, t)][0]), *want[(d, t)][1:]) for d, t in rows)
    assert all(len(r.l_kept or "") <= len(r.text or "") - sum(e - s for s, e in r.l_spans) for r in out)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_finds_passages_inside_lines(spark):
    rng = np.random.default_rng(9)
    words = lambda n: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5)) for _ in range(n))
    passage = ". ".join(words(9) for _ in range(6)) + "."
    docs = [(i, f"{words(40)} of {passage} {words(40)}. Oh no.") for i in range(3)] + [(3, "Oh no."), (4, "好好学习。\n好好学习。")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [out[i].l_passages for i in range(5)] == [0, 1, 1, 0, 0]
    # the passage's first sentence runs on from the text before it, and "Oh no." is too short a run to go
    assert out[1].l_passage_words == 45 and out[1].l_kept.endswith("Oh no.") and out[0].l_kept == docs[0][1]
    assert out[3].l_kept == "" and out[4].l_kept == "好好学习。\n"


def test_packing_is_optimal(docs, rows):
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, c = np.unique(rng.integers(1, 60, 9)), rng.integers(1, 20, 9)
        c = c[: len(x)]

        def waste(tops):
            return sum(int(n) * (min(t for t in tops if t >= v) - int(v)) for v, n in zip(x, c, strict=True))

        best = min(waste([*cut, x[-1]]) for k in range(min(3, len(x))) for cut in itertools.combinations(x[:-1], k))
        assert waste(packing.boundaries(x, c, 3)) == best
    out = packing.pack(docs).collect()
    assert len(out) == len(rows)
    for _, group in itertools.groupby(sorted(out, key=lambda r: r.batch_id), key=lambda r: r.batch_id):
        group = list(group)
        assert len(group) == 1 or len(group) * group[0].bucket_length <= 16384
        assert sorted(r.slot for r in group) == list(range(len(group)))


def test_mixing(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out, again = (sorted(map(tuple, mixing.mix(docs).select("doc_id", "m_size", "m_passes", "m_source_size", "m_target", "m_shards").collect())) for _ in range(2))
    assert out == again and all(p <= 3 and len(s) == p for _, _, p, _, _, s in out)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, largest = Counter(), {}, Counter()
    for d, size, p, _, t, _ in out:
        taken[source[d]] += size * p
        target[source[d]] = t
        largest[source[d]] = max(largest[source[d]], size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    quotas = np.array([5, 0, 17, 2])
    assert (mixing.split_quotas(quotas, 7, 3).sum(0) == quotas).all()
    assert mixing.fill_targets([10, 100], [1, 1], 110) == [30, 80]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(100005, None, "en"), (100006, "123 ...", None), (None, "abc", "en")], "doc_id long, text string, lang string")
    said = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.select("doc_id", "text", "lang").union(odd)).collect()}
    assert said[100005] == said[100006] == ("und", 0.0) and said[None][0] != "und"


def test_chat(spark):
    odd = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| é"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, "ro\nle\\n", "y"), (None, None, "assistant", "z")]
    turns = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in chat_format.read_back(turns).collect()}
    text = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert out[1].n_turns == 3 and out[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert out[1].loss_chars == len(odd) and out[1].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
    assert out[2].n_turns == 2 and out[None].loss_chars == 1
    written = {r.conv_id: r.text for r in chat_format.written_form(turns).collect()}
    assert len(written[1]) == out[1].formatted_chars
    assert chat_format.unescape(chat_format.escape(odd)) == odd


@pytest.mark.parametrize("shard_rows", [kd_search.SHARD_ROWS, 40])
def test_kd_search(spark, shard_rows):
    """One tree, and many shards of which one vector's copies fill several; repeated rows and a null id take part."""
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(700, 6)) * 2) / 64
    v[50:260] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [rows[3], rows[3], (1000, None), (1001, [float("nan")] * 6), (1002, [None] * 6), (1003, [5.0, 1.0]), (None, v[7].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    got = kd_search.top_k(df, df.filter("vec_id % 20 = 0"), shard_rows=shard_rows).collect()
    all_rows = [(i, np.floor(64 * np.array((x + [0.0] * 6)[:6])).astype(int)) for i, x in [*rows, odd[0], odd[1], odd[5], odd[6]]]
    want = Counter()
    for i, x in all_rows[:700:20]:
        order = sorted(((-int(x @ y), j is None, j or 0) for j, y in all_rows if j != i))[:20]
        want.update((i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(order))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert kd_search.top_k(df.limit(0), df).count() == kd_search.top_k(df, df.limit(0)).count() == 0


def test_kd_tree_splits_and_prunes():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 4)) * 60
    points = np.floor(centres[rng.integers(0, 30, 20_000)] + rng.normal(size=(20_000, 4)))
    tree = kd_search.Tree(points, np.arange(20_000))
    assert sum(x is not None for x in tree.kids) > 200
    touched = []

    class Seen(np.ndarray):
        def __matmul__(self, other):
            touched.append(len(self))
            return np.asarray(self) @ other

    tree.points = tree.points.view(Seen)
    got = kd_search.search(tree, points[:50], np.arange(50), np.full(50, -np.inf), 20)
    for i, (scores, _) in enumerate(got):
        assert scores.tolist() == sorted(np.delete(points @ points[i], i).tolist(), reverse=True)[:20]
    assert sum(touched) < 0.2 * 50 * len(points)
    splits = kd_search.cuts(points[:2000], 16)
    cell = kd_search.cells(points, splits)
    assert set(cell) == set(range(16)) and np.bincount(cell).max() < 0.15 * len(points)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, DIR).toPandas())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert docs.count() > 0


def test_language_keeps_every_language_and_count(spark):
    rng = np.random.default_rng(4)
    word = lambda i: "".join(chr(0x4E00 + 9 * i + int(c)) for c in rng.integers(0, 9, 5))
    rows = [(70 * k + i, " ".join(word(i) for _ in range(2 if i > 60 else 6)), f"l{i:02}") for k in range(15) for i in range(70)]
    docs = spark.createDataFrame([*rows, (5000, None, "l00"), (None, rows[0][1], None), rows[3]], "doc_id long, text string, lang string")
    whole = language_id.identify(docs).collect()
    lang = {i: x for i, _, x in rows}
    assert all(r.lang_pred == lang[r.doc_id] for r in whole if r.held_out and r.doc_id in lang)
    parts = language_id.identify(docs, pairs=9000, cells=300_000, group=40).collect()
    key = lambda r: (str(r.doc_id), r.held_out, r.lang_pred, r.accepted)
    assert Counter(map(key, parts)) == Counter(map(key, whole))
    xe = {r.doc_id: r.cross_entropy for r in whole}
    assert all(r.cross_entropy is None and xe[r.doc_id] is None or abs(r.cross_entropy - xe[r.doc_id]) < 1e-5 for r in parts)


def test_pipeline_cuts_passages_of_over_50_words(spark):
    rng = np.random.default_rng(6)
    words = lambda n, of=7: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, of)) for _ in range(n))
    long, short, least = words(51, 5), words(50, 9), words(51, 1)
    rows = [(i, f"{words(80)} {p} {words(80)}", "en", "s", 1, i) for i, p in enumerate([long, short, least] * 2)]
    out = {r.doc_id: r.text for r in corpus_pipeline.suffix_stage(spark, spark.createDataFrame(rows, SCHEMA), DIR).collect()}
    assert all(p in out[i] for i, p in enumerate([long, short, least]))
    assert long not in out[3] and short in out[4] and least not in out[5]


def test_pipeline_links_near_copies_from_80_per_cent(spark):
    words = [f"w{i}" for i in range(200)]
    copy = [*words[:180], *(f"x{i}" for i in range(20))]
    mine = [*words[:160], *(f"y{i}" for i in range(40))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, copy, mine)]
    assert 0.80 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85 and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.8
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1, i) for i, w in enumerate((words, copy, mine))], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, DIR).collect()) == [0, 2]


def test_packing_is_exact_over_many_lengths(spark):
    length = F.when(F.col("doc_id") == 0, 10_000_000).otherwise(3 * F.col("doc_id") + 1).cast("long")
    docs = spark.range(66_001).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    tops = packing.pack(docs, length, buckets=3).groupBy("bucket", "bucket_length").agg(F.min("padding").alias("least")).collect()
    # one bucket for the longest, and the others halve the rest
    assert sorted(r.bucket_length for r in tops) == [3 * 33_000 + 1, 3 * 66_000 + 1, 10_000_000] and all(r.least == 0 for r in tops)


def test_license_gates_allow_any_gap(spark):
    said = {
        "released into the public\ndomain": "public-domain", "some rights\nreserved": "reserved", "GNU General\nPublic License": "gpl,gpl-any", "Creative\n  Commons": "cc-any",
        "MIT-No attribution": "mit-0", "see the licence": "license-notice", "Do what the heck you want to public-licence": "wtfpl", "under the SIL Open\tFont Licence": "ofl-1.1",
    }
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert [r.c_labels for r in license_scan.scan(docs).orderBy("doc_id").collect()] == list(said.values())
