"""Extraction checks, cards, item lists and the ledger against their SQL, and the edges that the tables lack."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from offersieve.operators import grounding, ledger
from offersieve.plans import exchange
from offersieve.sources import items

DIR = "/root/testdata/sf0.001"


def _plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", exchange.QUERIES)
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    out = exchange.QUERIES[name](spark, DIR)
    columns = sorted(out.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({exchange.ORACLE[name]})").fetchall()
    assert _plain(out.select(*columns).collect()) == _plain(want)


def test_extraction_of_several_offers(spark):
    offer = '{"product_name":{"value":"ssd","evidence":"ssd  1tb"},"coupons":[],"highlights":[],"category":"home","link_ids":[%s]}'
    raw = lambda *o: '{"source_language":"en","prompt_injection_detected":true,"offers":[%s]}' % ",".join(o)  # noqa: E731, UP031
    two = [offer % '"a","b"', offer % '"c","d"']
    rows = [(0, raw(offer % '"a"')), (1, raw(*two)), (2, raw(*[offer % ""] * 4)), (3, raw(offer % '"a","a"')), (4, raw(offer % "null")), (5, None), (6, "[1]"), (7, raw("null")), (8, raw(offer % "").replace('"coupons":[]', '"coupons":[null]'))]
    links = F.array(*map(F.lit, "abcd"))
    fault = grounding.extraction_fault(F.col("raw"), F.lit("ssd 1tb"), links)
    got = [r.fault for r in spark.createDataFrame(rows, "id int, raw string").orderBy("id").select(fault.alias("fault")).collect()]
    assert got == [None, "links", "offer_count", "links", "links", "shape", "shape", "shape", "coupons"]


def test_item_list_of_odd_documents(spark):
    rows = [(1, "not json"), (2, None), (3, "{}"), (4, '{"@graph":[{"itemListElement":[1]},{"itemListElement":[2]}]}'), (5, '{"itemListElement":[]}'), (6, '{"itemListElement":[{"item":null},{"name":"a"}]}')]
    out = items.items(spark.createDataFrame(rows, "page int, raw string"), "raw", "page").orderBy("position").collect()
    assert [(r.page, r.position, r.skip_reason) for r in out] == [(6, 0, "missing_product"), (6, 1, "missing_offer")]


def test_cards_shrink_until_they_fit(spark):
    schema = "struct<category:string,product_name:string,availability:string,current_price:decimal(18,2),original_price:decimal(18,2),payment_terms:string,deal_callout:string,coupons:array<string>,seller:string,highlights:array<string>>"
    row = ("games", None, "x" * 300, None, None, "3x", "now", [], "s" * 500, ["h" * 300])
    df = spark.createDataFrame([(1, [row]), (2, [row, row]), (3, [row] * 400)], f"id int, offers array<{schema}>")
    card = {r.id: r.card for r in df.select("id", grounding.localized_card(F.col("offers"), F.lit("Why."), "en").alias("card")).collect()}
    assert "hhh" not in card[1] and "🏪" in card[1] and card[1].startswith("🎮 Promotion\nxxx") and card[1].endswith("\n\nWhy.")
    assert "🏪" not in card[2] and card[2].count("xxx" * 100) == 2 and card[3] is None


def test_ledger_edges(spark):
    empty = spark.createDataFrame([], "stage string, model string, attempts long")
    assert ledger.remaining(empty, "stage", {"evaluation": 5}, 9).first() == (0, 9, 5)
    done = spark.createDataFrame([(1, 1, "x" * 200, 3)], "id int, at int, outcome string, tokens int")
    out = {r.id: r for r in ledger.completed(spark.createDataFrame([(1,), (2,)], "id int"), done, "id", ["at"], "outcome", ["tokens"]).collect()}
    assert len(out[1].outcome) == 100 and out[2].outcome is None and out[2].tokens is None
    values, fault = ledger.string_list(F.col("v"))
    rows = spark.createDataFrame([(1, [" a", "b", "a "]), (2, []), (3, ["é" * 251]), (4, ["", "x" * 600])], "id int, v array<string>")
    assert [(len(r[0]), r[1]) for r in rows.orderBy("id").select(values, fault).collect()] == [(2, None), (0, "empty"), (1, "too_long"), (2, "empty_value")]


def test_extractions_are_spread_and_parsed_once(spark):
    """a small file of parts is no single task, and the text of an extraction is not made anew for every check."""
    out = exchange.QUERIES["extraction_faults"](spark, DIR)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("StructsToJsonEvaluator") == 1
