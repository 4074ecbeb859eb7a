"""Fingerprints against plain Python, on odd tables, and their merged and containment forms."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from offersieve.llm import fingerprints

LOW = str.maketrans(fingerprints.UPPER, fingerprints.LOWER)


def _hashes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
    grams = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [" ".join(words)] if words else []
    return sorted({h[:12] for h in (hashlib.md5(g.encode()).hexdigest() for g in grams) if h < "2"})


def _print(text):
    return hashlib.md5(text.translate(LOW).encode()).hexdigest()[:16] + ":" + ",".join(_hashes(text))


def _near(a, b):
    x, y = set(_hashes(a)), set(_hashes(b))
    return len(x & y) / len(x | y) if x | y else float(a.translate(LOW) == b.translate(LOW))


def _plain(rows):
    key = lambda r: (r[0] is None, r[0] or 0)
    rows = [(d, t or "") for d, t in rows]
    ids = sorted({key(r) for r in rows})
    out = []
    for d, t in rows:
        after = ids[(ids.index(key((d, t))) + 1) % len(ids)]
        k, most = len(t) // 2, max(len(x) for e, x in rows if key((e, x)) == key((d, t))) // 2
        head = min(((x[:most], _print(x)), x) for e, x in rows if key((e, x)) == after)[1]
        edited = t[: len(t) - k] + head[:k]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), _print(t), _print(edited), _near(t, edited), _near(t, head)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(900, None), (900, "two rows of one id " * 8), (901, ""), (902, " \n "), (903, "A b é漢🙂 d E f"), (None, "no id at all here now"), (None, None), (-4, "x " * 50_000), (904, "same"), (905, "SAME"), (906, "tie " * 9), (906, "tie " * 9)]
    return docs.union(spark.createDataFrame(odd, "doc_id long, text string")).repartition(4).cache()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_plain_python(docs):
    assert _rows(fingerprints.compare(docs)) == _plain([tuple(r) for r in docs.collect()])


def test_odd_tables(docs):
    few = docs.limit(7)
    wide = few.select("*", *(F.lit(1).alias(c) for c in ("no", "id", "own", "part", "after", "hashes", "edited", "n_chars")))
    assert _rows(fingerprints.compare(wide)) == _rows(fingerprints.compare(few))
    assert fingerprints.compare(docs.limit(0)).count() == 0
    one = docs.filter("doc_id = 3")
    row = fingerprints.compare(one).first()
    assert row.near_next == 1.0 and _plain([tuple(r) for r in one.collect()])[0][2] == row.edited_sha256


def test_no_python_in_the_plan(docs):
    plan = fingerprints.compare(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_groups(spark, docs):
    rows = [(d, t or "", "ab"[(d or 0) % 2]) for d, t in docs.collect()]
    prints = spark.createDataFrame(rows, "doc_id long, text string, g string").withColumn("fingerprint", fingerprints.fingerprint(F.col("text"), fingerprints.sketch(F.col("text"))))
    groups = fingerprints.merged(prints, "g")
    want = {g: set().union(*(_hashes(t) for _, t, k in rows if k == g)) for g in "ab"}
    assert {(r.g, r.hash) for r in groups.collect()} == {(g, h) for g, s in want.items() for h in s}
    got = sorted((repr(r.doc_id), r.g, r.share) for r in fingerprints.contained(prints, groups, "g").collect())
    plain = {(d, t): _hashes(t) for d, t, _ in rows}
    assert got == sorted((repr(d), g, len(want[g] & set(h)) / len(h)) for (d, _), h in plain.items() if h for g in "ab" if want[g] & set(h))
    pair = prints.filter("doc_id = 1").crossJoin(prints.filter("doc_id = 2").select(F.col("fingerprint").alias("other")))
    share = pair.select(fingerprints.containment(F.col("fingerprint"), F.col("other")).alias("s")).first().s
    x, y = (_hashes(next(t for d, t, _ in rows if d == k)) for k in (1, 2))
    assert share == (len(set(x) & set(y)) / len(x) if x else None)
