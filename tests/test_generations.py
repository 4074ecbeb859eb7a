"""Alias generations against a fresh index and a plain loop, with steps broken off between data and manifest row."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from offersieve.functions import text as X
from offersieve.operators import arrivals as A
from offersieve.operators.generations import AliasIndex, fingerprint

OLD = {"red thing": ["crimson"]}
NEW = {"red thing": ["crimson", "scarlet one"], "blue": ["azure"]}
WORDS = ["red", "thing", "crimson", "scarlet", "one", "blue", "azure", "plain"]


class Broken(Exception):
    pass


def _texts(n=60, seed=3):
    r = random.Random(seed)
    out = [[r.choice(WORDS) for _ in range(r.randrange(0, 6))] for _ in range(n)]
    out[4], out[5] = None, []
    return out


def _docs(spark, texts, first=0, parts=3):
    rows = [(3 * (first + i), t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, tokens array<string>, terms string").repartition(parts)


def _plain(texts, aliases):
    canon = [X.canonical_py(t or [], X.alias_groups(aliases)) for t in texts]
    return len(canon), round(sum(map(len, canon)) / len(canon), 9), dict(Counter(t for c in canon for t in set(c)))


def _said(index, limit=None):
    totals, df = index.statistics(limit)
    one = totals.first()
    return one["n"], one["avgdl"] and round(one["avgdl"], 9), {r.term: r.df for r in df.collect()}


def _break_next(monkeypatch, index):
    """The next step writes its data, but not its row."""

    def fail(state):
        monkeypatch.undo()
        raise Broken

    monkeypatch.setattr(index, "_commit", fail)


@pytest.fixture
def index(spark, tmp_path):
    return AliasIndex(spark, f"file://{tmp_path}/index", page=1)


def test_swap_equals_fresh(spark, index, tmp_path, monkeypatch):
    texts = _texts()
    assert index.start(OLD) and index.ready(OLD)
    assert index.insert(_docs(spark, texts[:30]), 0) == 30
    assert not index.start(NEW) and not index.start(NEW)
    assert not index.build_page()
    # a page, then an arrival, is broken off: nothing of it shows, and it can be run again with other files
    _break_next(monkeypatch, index)
    with pytest.raises(Broken):
        index.build_page()
    _break_next(monkeypatch, index)
    with pytest.raises(Broken):
        index.insert(_docs(spark, texts[30:45], 30), 1)
    assert _said(index) == _plain(texts[:30], OLD)
    again = AliasIndex(spark, index.root, page=1)
    assert again.insert(_docs(spark, texts[30:50], 30), 1) == 50
    assert again.insert(_docs(spark, texts[:9], 900), 1) == 50
    assert _said(again) == _plain(texts[:50], OLD)
    before = again.statistics()[1]
    again.build()
    assert again.ready(NEW) and again.build_page()
    assert {r.term: r.df for r in before.collect()} == _plain(texts[:50], OLD)[2]
    assert again.insert(_docs(spark, texts[50:], 50), 2) == 60
    fresh = AliasIndex(spark, f"file://{tmp_path}/fresh")
    fresh.start(NEW)
    fresh.insert(_docs(spark, texts), 0)
    rows = lambda i: sorted((r.id, r.len, sorted(r.terms)) for r in i.documents().collect())
    assert rows(again) == rows(fresh)
    again.vacuum()
    assert _said(again) == _plain(texts, NEW) == _said(fresh)


def test_swap_broken_off(spark, index, monkeypatch):
    texts = _texts(10)
    index.start(OLD)
    index.insert(_docs(spark, texts, parts=1), 0)
    index.start(NEW)
    _break_next(monkeypatch, index)
    with pytest.raises(Broken):
        index.build()
    assert index.ready(OLD) and _said(index) == _plain(texts, OLD)
    index.build()
    assert index.ready(NEW) and _said(index) == _plain(texts, NEW)


def test_active_aliases_end_a_build_and_others_replace_it(spark, index):
    texts = _texts(12)
    index.insert(_docs(spark, texts), 0)
    assert not index.start(OLD)
    index.build_page()
    assert index.start({}) and index.state().building == -1
    assert not index.start(OLD)
    assert not index.start(NEW)
    index.build()
    assert index.ready(NEW) and _said(index) == _plain(texts, NEW)


@pytest.mark.parametrize("limit", [0, 1, 7, 39, 40, 99])
def test_last_documents(spark, index, monkeypatch, limit):
    monkeypatch.setattr(A, "BLOCK", 4)
    texts = _texts(40)
    index.insert(_docs(spark, texts[:25]), 0)
    index.start(NEW)
    index.insert(_docs(spark, texts[25:], 25), 1)
    index.build()
    want = _plain(texts[-limit:], NEW) if limit else (0, None, {})
    assert _said(index, limit) == want


def test_refused_and_empty(spark, index):
    assert index.documents().count() == 0
    assert index.insert(_docs(spark, []), 0) == 0
    assert index.start(NEW)
    assert index.insert(_docs(spark, [["blue"], ["azure"]], 5), 1) == 2
    for rows, batch in ((_docs(spark, [["late"]], 5), 2), (_docs(spark, [["a"]], 9), 3), (_docs(spark, [["a"]], 9).union(_docs(spark, [["b"]], 9)), 2), (_docs(spark, [["a"]], 9).withColumn("id", F.lit(None)), 2)):
        with pytest.raises(ValueError):
            index.insert(rows, batch)
    assert _said(index) == (2, 1.0, {"blue": 2})


def test_stream(spark, index, tmp_path):
    """As the sink of a stream, one file a micro-batch."""
    texts = _texts(24)
    for i in range(3):
        _docs(spark, texts[8 * i : 8 * i + 8], 8 * i, 1).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    index.start(NEW)
    stream = spark.readStream.schema("id long, tokens array<string>").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    run = stream.writeStream.foreachBatch(lambda rows, n: index.insert(rows, n) and None).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert index.state().batch == 2 and _said(index) == _plain(texts, NEW)


def test_fingerprint():
    assert fingerprint({"b": ["x"], "a": ["é"]}) == fingerprint({"a": ["é"], "b": ["x"]}) != fingerprint({"a": ["é"], "b": ["y"]})
