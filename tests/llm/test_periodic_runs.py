"""Periodic runs against a plain search over all periods, and on odd tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from offersieve.llm import periodic_runs


def _plain(words, least=24, power=3):
    """start, length, period of all runs, by trying every period."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _plain(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_masking_length():
    assert periodic_runs.overlap() == 9
    assert periodic_runs.overlap(30, 3) == 11


@pytest.mark.parametrize("letters", [1, 2, 3, 6, 60])
def test_runs_against_all_periods(letters):
    rnd = random.Random(letters)
    for _ in range(60):
        words = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randrange(110))]
        for _ in range(rnd.randrange(4)):
            at, p = rnd.randrange(len(words) + 1), rnd.randrange(1, 20)
            words[at:at] = words[at : at + p] * rnd.randrange(1, 6)
        assert [tuple(r) for r in periodic_runs.find_runs(words).tolist()] == _plain(words)


def test_documents_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(5000, None), (5001, ""), (5002, " \n\t"), (None, "x y " * 40), (None, None), (5003, "a b c " * 9), (5003, "a b c " * 9), (5004, "é b\x0bc " * 30), (5005, "w " * 200_000), (-7, "p q " * 30)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = sorted((tuple(r) for r in periodic_runs.digest(docs.repartition(5)).collect()), key=repr)
    rows = [r for r in docs.collect() if len(r.text or "") < 100_000]
    assert [r for r in got if r[0] != 5005] == sorted((_plain_digest(*r) for r in rows), key=repr)
    assert [r[1:4] for r in got if r[0] == 5005] == [(1, 0, 200_000)]
    wide = docs.select("*", *(F.lit(1).alias(c) for c in ("h", "start", "length", "period", "n_runs", "runs", "kept")))
    assert sorted((tuple(r) for r in periodic_runs.digest(wide).collect()), key=repr) == got
    assert periodic_runs.digest(docs.limit(0)).count() == 0


def test_runs_and_their_texts(spark):
    rows = [(1, "intro " + "one two three " * 9 + "end"), (2, "nothing here"), (3, None)]
    out = {r.doc_id: r for r in periodic_runs.runs_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in out[1].runs] == [(1, 27, 3)] and out[1].kept == "intro one two three end" and out[1].n_words == 29
    assert out[2].runs == [] and out[2].kept == "nothing here" and out[3].n_words == 0 and out[3].kept == ""
