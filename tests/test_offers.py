"""Golden values of the text functions and the relevance operators, and every query against its SQL."""

import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from offersieve.functions import text as X
from offersieve.operators import relevance as R
from offersieve.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


NORMAL = [
    ("busdriver US$ 5 usdt USD", "busdriver usd 5 usdt usd"), ("prec\u0327o", "preco"), ("ＳＳＤ １ＴＢ", "ssd 1tb"), ("ﬁm Straße ½", None), ("Ŀ ĲSSEL", None),
    ("R$50,90 12,5% OFF", "brl 50.90 12.5 percent off"), ("1,2,3 a,b", "1.2.3 a b"), ("", ""), (None, ""),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, X.normalize(F.lit("PROMOÇÃO — R$ 1.299,90!!! 60% em https://x.test/a"))) == "promocao brl 1.299.90 60 percent em url"
    assert one(spark, X.fold_any(F.lit("ÁÇ"))) == one(spark, X.fold(F.lit("ÁÇ"))) == "ac"


@pytest.mark.parametrize("said, normal", NORMAL)
def test_normalize_golden(spark, said, normal):
    got = one(spark, X.normalize(F.lit(said).cast("string")))
    assert normal is None or got == normal == X.normal_py(said or "")
    assert got == one(spark, X.normalize(F.lit(said).cast("string"), X.fold_any))


def test_fold_agrees_with_unicode(spark):
    """Every assigned code point, between letters and before digits, comes out as the full folding has it."""
    chars = [chr(c) for c in (*range(0x20, 0xD800), *range(0xE000, 0x30000)) if unicodedata.category(chr(c)) not in ("Cn", "Co") and not chr(c).isspace()]
    lines = ["".join(f"a{c}b1{c}2 " for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, said string").select("i", X.normalize(F.col("said")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: X.normal_py(said) for i, said in enumerate(lines)}


@pytest.mark.parametrize("said, normal", [("oferta… hoje", "oferta... hoje"), ("1½", "11 2"), ("5 ㎏", "5 kg"), ("Ⅳ", "iv"), ("⑴ ㎡", "1 m2"), ("straße ½… ﬁm", "strasse 1 2... fim"), ("50％ por Ｒ＄ 9", "50 percent por brl 9"), ("BUSD usd, US$ 3 1,2,3", "busd usd usd 3 1.2.3")])
def test_normalize_signs_of_several_letters(spark, said, normal):
    assert one(spark, X.normalize(F.lit(said))) == normal == X.normal_py(said)


@pytest.mark.parametrize("said, cut", [("desconto 60 percentuais", None), ("SSD com 55% de desconto", 55), ("desconto de 60,5%", 60.5), ("off 0%", None), ("discount: 120%", None), ("20% off", 20)])
def test_stated_discount(spark, said, cut):
    assert one(spark, X.stated_discount(X.normalize(F.lit(said)))) == cut


@pytest.mark.parametrize("said, url", [(" https://a.b/x?a&b=1+2&UTM_x=1&ref=z&c=%C3%A9 ", "https://a.b/x?a=&b=1+2&c=%C3%A9"), ("http://a.b?q=a~b*c%zz", None), (None, ""), ("https://a.b/?a=b=c", "https://a.b?a=b%3Dc")])
def test_url_query(spark, said, url):
    got = one(spark, X.canonical_url(F.lit(said).cast("string")))
    assert url is None and got or got == url


@pytest.mark.parametrize("said, price", [("R$ 1.299,90", 1299.9), ("299.90", 299.9), ("R$2.645", 2645), ("R$ 1.234.567", 1234567), ("R$119", 119), ("$12.34", 12.34), (None, None)])
def test_price(spark, said, price):
    got = one(spark, X.parse_price(F.lit(said).cast("string")))
    assert (None if got is None else float(got)) == price


@pytest.mark.parametrize("said, price", [("SSD por R$ 299,90 com 55% de desconto", 299.9), ("De R$ 599 por R$ 339 em 7x", 339), ("SSD com 55% de desconto", None)])
def test_stated_price(spark, said, price):
    got = one(spark, X.stated_price(F.lit(said)))
    assert (None if got is None else float(got)) == price


@pytest.mark.parametrize("said, price", [("R$39,00", 39), ("R$2.599", 2599), ("Grátis", None), ("R$500OFF", None), ("Cupom de 20% OFF", None)])
def test_offer_price(spark, said, price):
    got = one(spark, X.offer_price(F.lit(said)))
    assert (None if got is None else float(got)) == price


def test_url(spark):
    assert one(spark, X.canonical_url(F.lit("HTTPS://Shop.Example/p/?utm_source=x&id=7#buy"))) == "https://shop.example/p?id=7"


def test_alias_match(spark):
    groups = X.alias_groups({"placa de video": ["gpu", "radeon"]})
    for doc, alt, want in [("Radeon RX 9070 XT", "GPU RX9070XT", True), ("Radeon RX 9070", "GPU RX9070XT", False)]:
        sig = X.significant(X.tokens(X.normalize(F.lit(doc))))
        assert one(spark, X.covers(X.canonical_tokens(sig, groups), X.canonical_py(X.significant_py(alt), groups))) is want


def test_bm25(spark):
    got = one(spark, R.bm25_of(F.lit(3), {"ssd": F.lit(2)}, {"ssd": 1.0}, F.lit(10), F.lit(3.0), {"ssd": F.lit(2)}))
    assert got == pytest.approx(2.0372062437707963)


def test_near_duplicate_sequence():
    offer = lambda at, price, url="u": {"at": at, "url": url, "price": price, "models": [], "product": [], "strong": False}
    kept, said = [], []
    for price in (3000, 3000, 3200, 2800, 2900, 2799):
        reason, kept = R.near_duplicate_step(kept, offer(0.0, price), 600)
        said.append(reason)
    assert [r is None for r in said] == [True, False, False, True, False, True]
    reason, _ = R.near_duplicate_step([offer(0.0, 5)], offer(600.0, 5), 600)
    assert reason is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DIR)
    result = con.execute(catalogue.ORACLE[name])
    cols = [c[0] for c in result.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda rows, names: sorted(tuple(str(round(r[names.index(c)], 6) if isinstance(r[names.index(c)], float) else r[names.index(c)]) for c in sorted(cols)) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(result.fetchall(), cols)


def test_link_spam_in_replay_and_fanout(spark, tmp_path):
    links = " ".join(f"ing und https://x.test/{i}" for i in range(5))
    texts = [links, links.rsplit(" ", 1)[0], *(f"word{i} other" for i in range(8))]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 2), 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = {(r.user_id, r.doc_id): r.stage for r in catalogue.QUERIES["user_fanout_decisions"](spark, str(tmp_path)).collect()}
    assert all((stages[u, 0] == "hard_filter") and stages[u, 1] != "hard_filter" for u in (1, 2, 3))
    r = catalogue.QUERIES["replay_metrics"](spark, str(tmp_path)).first()
    assert (r.relevant, r.kept) == (2, 1)


def test_steps_are_left_out_where_no_sign_asks_for_them(spark):
    """F2 to F10: texts are scanned by expressions only where a cheap look finds what they need; all forms agree."""
    said = ["plain words", "a_b x_", "a1 1a 2b", "é ß ½ …", "us$ 5 usd r$ 3,50", "5% off", "http://a.b", "", "bom dia", "xbom diax", "the the_thing ation"]
    rows = spark.createDataFrame([(x,) for x in said], "said string").withColumn("n", X.normalize(F.col("said")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan and "Contains" in plan or "contains" in plan.lower()
    for r in rows.withColumns({"t": X.tokens(F.col("n")), "s": X.significant_of(F.col("n"))}).withColumns({"c": X.term_counts(F.col("t"), ["the", "a", "none"]), "plain": X.significant(F.col("t"))}).collect():
        words = X.normal_py(r.said)
        assert r.n == words and r.s == r.plain == X.significant_py(r.said)
        assert list(r.c) == [r.t.count(x) for x in ("the", "a", "none")]


def test_letters_and_digits_are_found_in_one_scan(spark):
    """F8: Latin letters are replaced by one scan, not one a letter, and digits set apart by one more."""
    said = ["é", "açúcar ÀÉÎÕÜ", "ßaß—é", "日本é x", "ﬁé½", "a1b22c 3d_4e.5f 12.50 the1the", "1", "", "é\nü"]
    rows = spark.createDataFrame([(x,) for x in said], "said string").withColumn("n", X.normalize(F.col("said")))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("replace(") < 10
    rows = rows.withColumns({"s": X.significant_of(F.col("n")), "plain": X.significant(X.tokens(F.col("n")))})
    for r in rows.collect():
        assert r.n == X.normal_py(r.said) and r.s == r.plain == X.significant_py(r.said)


def test_exclusions_take_canonical_tokens_that_are_there(spark):
    """fan-out draws aliases together once; phrases are looked for in one text."""
    aliases = {"red thing": ["crimson"], "blue": ["azure"]}
    rows = spark.createDataFrame([("a crimson b",), ("red x thing",), ("azure",), ("plain red",), ("",)], "said string")
    sig = F.split("said", " ")
    canon = X.canonical_tokens(sig, X.alias_groups(aliases))
    one, two = (R.exclusion(sig, ["crimson", "plain red", "azure"], aliases, c) for c in (canon, None))
    got = rows.select(one.alias("a"), two.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == ["crimson", "crimson", "azure", "plain red", None]
    # the canonical tokens stand for themselves, which the offer's own would not give
    assert rows.select(R.exclusion(sig, ["azure"], aliases, F.array(F.lit("blue"))).alias("a")).first().a == "azure"


def test_aliases_remove_tokens_without_a_scan_by_expressions(spark):
    """tokens of matching variants are removed one by one; nulls, repeats and shared tokens stay as they were."""
    groups = [("m", [["a", "b"], ["c"], []]), ("n", [["b", "d"], ["x"]]), ("o", [[]])]
    lists = [["a", "b", "a", "z"], ["a", "d"], ["b", "d", "a", "c"], ["c", "c", "z"], [], ["x", "b"], ["z"]]
    rows = spark.createDataFrame([(x,) for x in [*lists, [None, "a", "b"]]], "t array<string>").withColumn("c", X.canonical_tokens(F.col("t"), groups))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_remove" in plan and "filter(" not in plan
    got = [list(r.c) for r in rows.collect()]
    assert got == [*[X.canonical_py(x, groups) for x in lists], [None, "m"]]
