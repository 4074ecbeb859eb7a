"""Figures as of arrival against a plain loop, over blocks small enough that all levels of the running sums are passed."""

import math
import random

import pytest
from pyspark.sql import functions as F

from offersieve.operators import arrivals as A

LIMITS = [1, 3, 10, 500]
TERMS = "user_id long, term string, weight double"


def _corpus(n=90, seed=5):
    r = random.Random(seed)
    out = [[r.choice(["hot", "hot", "a", "b", "c", "d"]) for _ in range(r.randrange(0, 7))] for _ in range(n)]
    out[4], out[5] = None, []
    return out


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq long, tokens array<string>").repartition(5)


def _scores(docs, terms, limit):
    """Ids are three times the order of arrival; figures come back by order of arrival."""
    lengths, posted = A.postings(docs.withColumn("doc_id", F.col("seq") * 3).drop("seq"), "doc_id", "tokens", terms)
    return A.scores(lengths, posted, terms, limit)


@pytest.fixture(autouse=True)
def _small_blocks(monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 4)


@pytest.mark.parametrize("limit", LIMITS)
def test_scores(spark, limit):
    texts = _corpus()
    asked = [(1, "hot", 1.0), (1, "a", 0.5), (1, "a", 0.7), (1, "a", 0.7), (2, "d", 1.3), (2, "none", 1.0), (3, "none", 2.0)]
    got = {(r.user_id, r.seq): r.score for r in _scores(_docs(spark, texts), spark.createDataFrame([*asked, (4, "", 1.0)], TERMS), limit).collect()}
    want = {}
    for seq, text in enumerate(texts):
        last = [t or [] for t in texts[max(0, seq - limit + 1) : seq + 1]]
        n, mean = len(last), max(sum(map(len, last)) / len(last), 1.0)
        for user, weights in ((1, {"hot": 1.0, "a": 0.7}), (2, {"d": 1.3})):
            for term, w in weights.items():
                tf, df = (text or []).count(term), sum(term in t for t in last)
                if tf:
                    want[user, seq] = want.get((user, seq), 0.0) + w * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(text) / mean))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("limit", LIMITS)
def test_counts_and_lengths(spark, limit):
    texts = [t or [] for t in _corpus(70, 9)]
    docs = _docs(spark, texts)
    stats = {r.seq: (r.len, r.n, round(r.avgdl, 9)) for r in A.rolling_stats(docs.select("seq", F.size("tokens").alias("len")), limit).collect()}
    df = {(r.seq, r.term): r.df for r in A.rolling_df(docs.select("seq", F.explode(F.array_distinct("tokens")).alias("term")), limit).collect()}
    lasts = {i: texts[max(0, i - limit + 1) : i + 1] for i in range(len(texts))}
    assert stats == {i: (len(texts[i]), len(x), round(sum(map(len, x)) / len(x), 9)) for i, x in lasts.items()}
    assert df == {(i, t): sum(t in x for x in lasts[i]) for i in lasts for t in set(texts[i])}


def test_ranks_of_ids_with_gaps(spark):
    ids = [*range(-9, 3), 17, 40, 41, 1000]
    rows = spark.createDataFrame([(i, f"x{i}") for i in ids], "doc_id long, text string").repartition(4)
    assert [(r.doc_id, r.text, r.seq) for r in A.dense(rows, "doc_id").orderBy("seq").collect()] == [(i, f"x{i}", k) for k, i in enumerate(ids)]


def test_empty_tables(spark):
    docs, terms = _docs(spark, []), spark.createDataFrame([], TERMS)
    assert _scores(docs, terms, 5).count() == _scores(_docs(spark, [["a"]]), terms, 5).count() == 0
    assert A.dense(docs, "seq").count() == A.rolling_stats(docs.select("seq", F.lit(1).alias("len")), 5).count() == 0


def test_windows_are_of_blocks(spark):
    """No window runs over all rows of a term: each is of a part, of the parts of a group, or of groups."""
    docs = _docs(spark, _corpus(20))
    plan = A.rolling_df(docs.select("seq", F.explode("tokens").alias("term")), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "[term#" in plan and all("part" in w or "up" in w for w in plan.splitlines() if "Window [" in w)


def test_rolling_counts_take_one_shuffle(spark):
    """a row meets its block once; before, running sums were joined to it."""
    docs = _docs(spark, _corpus(20))
    plan = A.rolling_df(docs.select("seq", F.explode("tokens").alias("term")), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("limit", LIMITS)
def test_best_users(spark, limit, monkeypatch):
    """blocks of arrivals meet blocks of users, and no pair of them is a row."""
    monkeypatch.setattr(A, "AT_ONCE", 7)
    monkeypatch.setattr(A, "USERS", 2)
    r, texts = random.Random(3), _corpus()
    asked = [(u, r.choice(["hot", "a", "b", "c", "d", "none", ""]), r.choice([0.5, 1.0, 1.3])) for u in (9, 2, 7, 4, 5, 1) for _ in range(3)]
    asked += [(20, "hot", 1.0), (21, "hot", 1.0)]
    terms = spark.createDataFrame(asked, TERMS)
    found = {}
    for row in _scores(_docs(spark, texts), terms, limit).collect():
        found.setdefault(row.seq * 3, []).append((row.user_id, row.score))
    want = {d: (len(x), max(x, key=lambda us: (round(us[1], 6), -us[0]))[0], round(max(s for _, s in x), 6), round(sum(s for _, s in x), 4)) for d, x in found.items()}
    docs = _docs(spark, texts).withColumn("doc_id", F.col("seq") * 3).drop("seq")
    got = {row.doc_id: tuple(row)[1:] for row in A.best_users(docs, "doc_id", "tokens", terms, limit).collect()}
    assert got.keys() == want.keys()
    assert all(got[d][:2] == want[d][:2] and got[d][2:] == pytest.approx(want[d][2:], abs=2e-4) for d in want)
    none = spark.createDataFrame([], TERMS)
    assert A.best_users(docs, "doc_id", "tokens", none, limit).count() == A.best_users(docs.limit(0), "doc_id", "tokens", terms, limit).count() == 0


def _best(spark, texts, asked, limit):
    terms, found = spark.createDataFrame(asked, TERMS), {}
    for row in _scores(_docs(spark, texts), terms, limit).collect():
        found.setdefault(row.seq * 3, []).append((row.user_id, row.score))
    want = {d: (len(x), max(x, key=lambda us: (round(us[1], 6), -us[0]))[0], round(max(s for _, s in x), 6), round(sum(s for _, s in x), 4)) for d, x in found.items()}
    docs = _docs(spark, texts).withColumn("doc_id", F.col("seq") * 3).drop("seq")
    got = {row.doc_id: tuple(row)[1:] for row in A.best_users(docs, "doc_id", "tokens", terms, limit).collect()}
    assert got.keys() == want.keys()
    assert all(got[d][:2] == want[d][:2] and got[d][2:] == pytest.approx(want[d][2:], abs=2e-4) for d in want)


@pytest.mark.parametrize("most", [3, 12])
def test_best_users_of_any_number_of_terms(spark, most):
    """bounds leave no best user out, whether users have few or many terms, also where weights are below zero."""
    r, words = random.Random(most), [f"w{i}" for i in range(40)]
    texts = [[words[min(int(r.expovariate(0.15)), 39)] for _ in range(r.randrange(0, 30))] for _ in range(60)]
    asked = [(u, r.choice(words), r.choice([-0.4, 0.5, 0.5, 1.3])) for u in range(900) for _ in range(r.randrange(1, most + 1))]
    _best(spark, texts, asked, 20)


def test_users_are_counted_by_bits():
    """users of a document are counted without a step for each pair of them; before, each pair was added up."""
    import numpy as np

    r = np.random.default_rng(4)
    at, term = (x.ravel() for x in np.nonzero(r.random((4500, 30)) < 0.02))
    order = np.lexsort((at, term))
    many = r.integers(1, 6, 2500)
    first, term_of = np.cumsum(many) - many, r.integers(0, 30, many.sum())
    said = np.zeros((4500, 30), bool)
    said[at, term] = True
    want = sum(said[:, term_of[a : a + n]].any(axis=1).astype(int) for a, n in zip(first, many))
    assert (A._concerned(term[order], at[order], 4500, term_of, first, many) == want).all()


def test_blocks_grow_with_users(spark, monkeypatch):
    """users' terms meet every block, so blocks grow with them (to four times); before, they were shuffled once for each 8,192 documents."""
    sizes, plain = [], A._blocks
    monkeypatch.setattr(A, "AT_ONCE", 7)
    monkeypatch.setattr(A, "PER_ARRIVAL", 1, raising=False)
    monkeypatch.setattr(A, "_blocks", lambda limit, block=A.BLOCK: (sizes.append(block), plain(limit, block))[1])
    docs = _docs(spark, [["a"]]).withColumnRenamed("seq", "doc_id")
    for users in (3, 20, 90):
        A.best_users(docs, "doc_id", "tokens", spark.createDataFrame([(u, "a", 1.0) for u in range(users)], TERMS), 5)
    assert sizes == [7, 20, 28]
