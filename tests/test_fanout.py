"""The cascade over stored users: by hand on small tables, and which stages the queries reach."""

import duckdb
from pyspark.sql import functions as F

from offersieve.operators import fanout
from offersieve.operators.lineage import written
from offersieve.plans import users

OFFERS = "doc_id long, words string, n_sig int, title_tokens array<string>, price double, fixed string, exceptional string, replay boolean"
INTERESTS = "user_id long, interest_id string, terms array<array<string>>, importance long, min_price double, max_price double, excluded array<array<string>>"


def _tables(spark, interests=(), aliases=(), exclusions=(), rules=(), settings=()):
    own = {u: (u, False, 0.0, "live") for u in (1, 2, 3)} | {s[0]: s for s in settings}
    return {
        "users": spark.createDataFrame(list(own.values()), "user_id long, exceptional_on boolean, threshold double, mode string"),
        "interests": spark.createDataFrame(list(interests), INTERESTS),
        "aliases": spark.createDataFrame(list(aliases), "user_id long, marker string, variants array<array<string>>"),
        "exclusions": spark.createDataFrame(list(exclusions), "user_id long, ord int, phrase array<string>"),
        "rules": spark.createDataFrame(list(rules), "user_id long, priority int, rule_id string, action string, parts array<array<array<string>>>"),
    }


def _offers(spark, *texts, **more):
    rows = []
    for i, t in enumerate(texts):
        own = more.get(f"o{i}", {})
        rows.append((i, t, len([w for w in t.split() if w != "de"]), t.split()[:3], own.get("price"), own.get("fixed"), own.get("exceptional"), own.get("replay", False)))
    return spark.createDataFrame(rows, OFFERS)


def _made(spark, offers, **tables):
    t = _tables(spark, **tables)
    made = fanout.decisions(offers.select("doc_id", "words"), offers, **t)
    rows = {(r.doc_id, r.user_id): (r.stage, r.reason) for r in made.collect()}
    counts = {(r.user_id, r.stage, r.reason): r.n for r in fanout.decision_counts(offers, t["users"], made, t["interests"]).collect()}
    assert sum(counts.values()) == offers.count() * t["users"].count()
    return rows, counts


def test_aliases_draw_tokens_together(spark):
    """A marker that is a plain word, a word that a matching variant takes away, and a term of one marker alone."""
    offers = _offers(spark, "solid state disk", "ssd fast", "state only", "disk", "")
    want = [(1, "a", [["ssd"]], 50, None, None, []), (2, "a", [["state"]], 50, None, None, []), (3, "a", [["disk", "fast"], ["disk"]], 50, None, None, [])]
    alias = [(1, "ssd", [["ssd"], ["solid", "state"]]), (2, "ssd", [["ssd"], ["solid", "state"]]), (3, "disk", [["ssd"], ["zip"]])]
    made, counts = _made(spark, offers, interests=want, aliases=alias)
    met = {k for k, (stage, _) in made.items() if stage == "deterministic"}
    # the first user's term is the marker; the second's word is drawn away in the first offer; the third's marker is a word
    assert met == {(0, 1), (1, 1), (2, 2), (0, 3), (3, 3), (1, 3)}
    assert counts[1, "interest_admission", "interest_candidate_miss"] == 3 and counts[2, "interest_admission", "interest_candidate_miss"] == 4


def test_every_step_in_order(spark):
    offers = _offers(spark, "big red car", "big red car now", "spam red", "red wine", "blue car", "green de tea", o0={"price": 10.0}, o1={"replay": True}, o2={"fixed": "link_spam"}, o3={"exceptional": "explicit_phrase:x"}, o4={"price": 99.0, "exceptional": "hot"})
    want = [(1, "a", [["red"]], 50, 20.0, None, []), (1, "b", [["blue", "car"]], 50, None, 50.0, []), (2, "a", [["car"]], 50, None, 100.0, [["blue"]]), (3, "a", [["tea"]], 100, None, None, [])]
    rules = [(2, 5, "ok", "allow", [[["big", "red"]]]), (2, 9, "no", "deny", [[["red"]], [["car"], ["wine"]]]), (3, 1, "de", "deny", [[["green", "de"]]])]
    made, counts = _made(spark, offers, interests=want, rules=rules, exclusions=[(1, 0, ["now"]), (3, 0, ["car", "red"]), (3, 1, ["red", "wine"])], settings=[(1, True, 0.0, "shadow"), (4, False, 1.0, "off"), (5, True, 1.0, "off")])
    assert made[0, 1] == ("constraints", "price_below_minimum:a")
    assert made[1, 1] == ("deduplication", "native_replay") and made[2, 1] == ("hard_filter", "link_spam")
    assert made[3, 1][0] == "deterministic" and made[3, 1][1].endswith("uncertain_exceptional")
    assert made[4, 1] == ("constraints", "price_above_maximum:b")
    assert made[4, 2] == ("constraints", "excluded_attribute:a:blue") and made[0, 2][0] == "deterministic"
    assert made[3, 2] == ("hard_filter", "rule_deny:no") and made[5, 3] == ("hard_filter", "rule_deny:de")
    assert made[3, 3] == ("exclusion", "explicit_exclusion:red wine")
    assert counts[4, "idle", "no_interests_and_exceptional_disabled"] == 6
    assert counts[5, "exceptional", "hot"] == 1 and counts[5, "exceptional", "explicit_phrase:x"] == 1 and counts[5, "bm25", "below_threshold"] == 2


def test_empty_tables(spark):
    none = _offers(spark, "a b").limit(0)
    t = _tables(spark)
    assert fanout.decisions(none, none, **t).count() == 0
    offers = _offers(spark, "a b")
    made = fanout.decisions(offers.select("doc_id", "words"), offers, **t)
    assert made.count() == 0
    assert {(r.user_id, r.stage, r.n) for r in fanout.decision_counts(offers, t["users"], made, t["interests"]).collect()} == {(u, "idle", 1) for u in (1, 2, 3)}


def test_queries_reach_every_stage(spark):
    con = duckdb.connect()
    for t in ("documents", "nation", "part"):
        con.sql(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.01/{t}.parquet'")
    stages = {r[0] for r in con.sql(f"SELECT DISTINCT stage FROM ({users.ORACLE['user_stage_counts']})").fetchall()}
    assert stages == {"idle", "deduplication", "hard_filter", "exclusion", "constraints", "exceptional", "bm25", "bm25_auto_forward", "interest_admission", "deterministic"}
    got = users.user_cascade(spark, "/root/testdata/sf0.001")
    assert {s.stage for s in got.select("stage").distinct().collect()} <= stages and not got.filter(F.col("stage").isNull()).count()


def test_only_wanted_tokens_are_shuffled(spark):
    """postings meet a small table of wanted tokens before any shuffle, and count as before."""
    texts = spark.createDataFrame([(1, "de red a1b red"), (2, "blue de"), (3, "")], "doc_id long, words string")
    wanted = written(spark.createDataFrame([("red",), ("de",), ("a1b",), ("a",)], "token string"))
    got = fanout.postings(texts, wanted)
    assert {tuple(r) for r in got.collect()} == {(1, "red", 2), (1, "de", 0), (1, "a1b", 0), (1, "a", 1), (2, "de", 0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "named_struct" not in plan


def test_words_are_cut_from_the_users_texts_only(spark):
    """texts that no user takes words from leave before any of their tokens is made."""
    texts = written(spark.createDataFrame([(i, f"w{i} x y z") for i in range(2000)], "doc_id long, words string"))
    tables = users.tables_of(spark, "/root/testdata/sf0.001", texts)
    assert tables["users"].count() == 25
    alone = texts.filter("doc_id < 80")
    again = users.tables_of(spark, "/root/testdata/sf0.001", alone)
    for name in tables:
        assert sorted(map(str, tables[name].collect())) == sorted(map(str, again[name].collect()))
