"""Sources, preferences, admission, queues and their streaming forms."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from offersieve.operators import admission, preferences, service
from offersieve.operators.relevance import near_duplicate_step
from offersieve.operators.service import admitted_step
from offersieve.plans import control
from offersieve.sources import feed, messages, records, settings
from offersieve.streaming import folds

SF = "/root/testdata/sf0.001"
PROBLEMS = [None, "importance", "importance", "name", "price_order", "synonyms", None, "rule_id", "action", "matcher", "priority", "terms", None, "kind"]
FOUND = [("SSD", None), ("", "missing_title"), ("Cabo", "missing_url"), ("Blog", "non_deal_item"), ("Dois", "conflicting_duplicate_card"), ("Sem", "missing_rendered_card"), ("Mouse", "title_mismatch")]


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_entry_problems_are_the_expected_ones(spark):
    assert [p for _, p in sorted(rows(control.entry_validation(spark, SF), "id", "problem"))] == PROBLEMS


def test_feed_items_meet_their_cards(spark):
    got = sorted(rows(control.feed_offers(spark, SF), "position", "title", "skip_reason"))
    assert [(t, r) for _, t, r in got] == FOUND
    pages = spark.createDataFrame([(1, control.FEED), (2, None), (3, "")], "page_id long, html string")
    good = feed.offers(pages, control.ORIGIN, control.STORES).filter("skip_reason IS NULL").collect()
    assert [(r.page, r.id, r.temperature, r.image, r.text, r.url) for r in good] == [(1, "1", 310, "https://i/2", "Vendido por Loja", "https://shop.example/d/a")]
    assert float(good[0].price) == 1299.90
    assert dict(rows(feed.skips(feed.offers(pages, control.ORIGIN, control.STORES)), "skip_reason", "first"))["missing_title"] == "2"


def test_cards_without_an_id_fill_gaps_and_conflicts_show(spark):
    c = [("p", "u", "1", "T", "", "5", "", ""), ("p", "u", "", "other", "9", "5", "", ""), ("p", "v", "", "a", "", "", "", ""), ("p", "v", "", "b", "", "", "", ""), ("p", "w", "1", "", "", "", "", ""), ("p", "w", "2", "", "", "", "", "")]
    got = {r.url: r for r in feed.merged(spark.createDataFrame(c, "page string, url string, id string, title string, price string, temperature string, image string, store string")).collect()}
    assert (got["u"].title, got["u"].price, got["u"].conflict) == ("T", "9", False)
    assert got["v"].conflict and got["w"].conflict


def test_details_enrich_offers(spark):
    html = '<script type="application/ld+json">{"offers": {"price": "10,50"}, "description": "a <b>good</b> one"}</script>'
    d = feed.details(spark.createDataFrame([("https://x/d/a", html), ("https://x/d/b", None)], "url string, html string"))
    offers = spark.createDataFrame([("https://x/d/a", "t", None), ("https://x/d/a", "a good one", 3.0), ("https://x/d/c", "t", None)], "url string, text string, price double").withColumn("price", F.col("price").cast("decimal(18,2)"))
    got = sorted(rows(feed.enriched(offers, d), "url", "text", F.col("price").cast("double")), key=str)
    assert got == [("https://x/d/a", "a good one", 3.0), ("https://x/d/a", "t\na good one", 10.5), ("https://x/d/c", "t", None)]


def test_message_offers(spark):
    m = spark.createDataFrame([(1, 2, " \n SSD 1TB \npor R$ 99,90 https://a/b. https://a/b)"), (1, 3, None)], "chat long, n long, t string")
    a, b = sorted(messages.offers(m, "chat", "n", "t").collect())
    assert (a.id, a.title, a.urls, float(a.price)) == ("1:2", "SSD 1TB", ["https://a/b"], 99.9)
    assert (b.id, b.title, b.urls, b.price) == ("1:3", None, [], None)


def test_labelled_lines(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"id": "1", "title": "x", "price": "9.90", "relevant": true}\n\n{"promotion": {"id": "2", "title": "y"}, "relevant": false}\n')
    got = sorted(rows(records.labelled(spark, str(good)), "id", "title", F.col("price").cast("string"), "relevant"))
    assert got == [("1", "x", "9.90", True), ("2", "y", None, False)]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"id": "1", "title": "x"}\n')
    with pytest.raises(Exception, match="not a labelled offer"):
        records.labelled(spark, str(bad)).collect()


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / "s.yaml"
    f.write_text("state: {corpus_limit: '${LIMIT_X:-10}'}\na: '${NAME_X:-word}'\n")
    assert settings.load(str(f)) == {"state": {"corpus_limit": 10}, "a": "word"}
    monkeypatch.setenv("LIMIT_X", "0")
    monkeypatch.setenv("NAME_X", "12")
    with pytest.raises(settings.SettingsError):
        settings.load(str(f))


def test_admission_opens_and_closes_circuits(spark):
    caps = admission.Caps(daily=4, per_minute=2, stages={"a": 3})
    at = [(0, "a"), (1, "a"), (2, "a"), (30, "a"), (61, "a"), (200, "a"), (201, "b"), (202, "b"), (400, "b"), (500, "a")]
    base = dt.datetime(2024, 1, 2, 12)
    log = spark.createDataFrame([(1, i, base + dt.timedelta(seconds=s), g) for i, (s, g) in enumerate(at)], "k long, seq long, ts timestamp, stage string")
    got = [v for _, v in sorted(rows(admission.admissions(log, "k", "seq", "ts", "stage", caps), "seq", "verdict"))]
    assert got == ["admitted", "admitted", "rate_budget", "temporary_circuit", "probe", "a_budget", "admitted", "daily_budget", "daily_circuit", "daily_circuit"]


def test_preference_changes_apply_whole_or_not(spark):
    op = lambda a, e, **d: {"action": a, "entry_id": e, "data": d}
    log = [(1, 1, 0, [op("add", "x", c={"lo": 1})]), (1, 2, 0, [op("add", "y")]), (1, 3, 1, [op("update", "x", c={"hi": 2}), op("remove", "z")]), (1, 4, 1, [op("update", "x", c={"hi": 2})]), (2, 1, 0, []), (2, 2, 0, [op("add", "q")]), (1, 5, 2, [op("remove", "x")])]
    df = spark.createDataFrame([(u, s, b, json.dumps(o)) for u, s, b, o in log], "user_id long, seq long, base_revision long, operations string")
    got = sorted(rows(preferences.folded(df), "user_id", "seq", "outcome", "revision", "entries"))
    assert [g[2:4] for g in got] == [("applied", 1), ("stale", 1), ("missing", 1), ("applied", 2), ("applied", 3), ("operations", 0), ("applied", 1)]
    assert json.loads(got[3][4]) == {"x": {"c": {"lo": 1, "hi": 2}}}
    assert preferences.folded(df.limit(0)).count() == 0


def test_queue_after_a_drain(spark):
    q = spark.createDataFrame([(i, 1, "pending", dt.datetime(2024, 1, 1)) for i in range(4)], "id long, attempts int, status string, next_attempt timestamp")
    o = spark.createDataFrame([(0, "sent", None), (1, "permanent", None), (2, "timeout", 1.0)], "id long, outcome string, retry_after double")
    got = sorted(rows(service.after_delivery(q, o, now=F.timestamp_seconds(F.lit(1704067200))), "id", "attempts", "status", F.unix_timestamp("next_attempt")))
    assert got == [(0, 2, "delivered", 1704067200), (1, 2, "failed", 1704067200), (2, 2, "pending", 1704067205), (3, 1, "pending", 1704067200)]


def test_retention_passes(spark):
    log = spark.range(20).withColumn("at", F.timestamp_seconds(F.col("id")))
    gone = sorted(r.id for r in service.doomed(log, "at", "id", F.timestamp_seconds(F.lit(3)), cap=15, batch=10).collect())
    assert gone == [0, 1, 2, 3, 4]
    assert service.doomed(log, "at", "id", F.timestamp_seconds(F.lit(0)), cap=50).count() == 0


def _stream(spark, tmp_path, df, name, apply, batches):
    src = tmp_path / name
    for b in batches:
        df.filter(b).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = apply(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}_cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_limiter_equals_the_fold(spark, tmp_path):
    rng = random.Random(5)
    ev = sorted((rng.randrange(3), rng.randrange(400)) for _ in range(60))
    ev = [(k, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(sorted(ev, key=lambda e: e[1]))]
    df = spark.createDataFrame(ev, "key long, seq long, ts timestamp")
    got = {r.seq: r.admitted for r in _stream(spark, tmp_path, df, "limiter", lambda s: folds.admitted(s, "key", "seq", "ts", ((60.0, 2),), "1 hour"), ["seq < 30", "seq >= 30"])}
    want, logs = {}, {}
    for k, i, t in ev:
        want[i], logs[k] = admitted_step(logs.get(k, []), t.timestamp(), ((60.0, 2),))
    assert got == want


def test_streamed_near_duplicates_equal_the_fold(spark, tmp_path):
    rng = random.Random(6)
    data = [(rng.randrange(2), i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=20 * i), rng.choice(["u", "v", None]), rng.choice([None, 5, 6, 7]), [rng.choice(["m1", "m2"])], ["a", "b"], True) for i in range(40)]
    df = spark.createDataFrame(data, "user long, seq long, ts timestamp, canonical string, stated int, models array<string>, product array<string>, strong boolean").withColumn("stated", F.col("stated").cast("decimal(18,2)"))
    got = {r.seq: r.reason for r in _stream(spark, tmp_path, df, "nearby", lambda s: folds.near_duplicates(s, "user", "ts", 200.0, "1 hour"), ["seq < 20", "seq >= 20"])}
    want, kept = {}, {}
    for u, i, t, url, price, models, product, strong in data:
        row = {"at": t.timestamp(), "url": url, "price": price, "models": models, "product": product, "strong": strong}
        want[i], kept[u] = near_duplicate_step(kept.get(u, []), row, 200.0)
    assert got == want and any(want.values()) and not all(want.values())


def test_streamed_first_seen_and_hours(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i)) for i in range(12)], "key long, v long, ts timestamp")
    assert len(_stream(spark, tmp_path, df, "firsts", lambda s: folds.first_seen(s, ["key"], "ts"), ["v < 6", "v >= 6"])) == 3
    done = _stream(spark, tmp_path, df, "hours", lambda s: folds.hourly(s, "ts", "key", "v", "1 minute"), ["v < 6", "v >= 6"])
    assert sorted((r.key, r.n, r.total) for r in done if r.start.hour == 0) == [(0, 2, 3), (1, 2, 5), (2, 2, 7)]
