"""Offers from feed pages: rendered cards beside a JSON-LD list. All of it is columns: a card is the stretch from its
anchor to the next card's anchor, found by regular expressions, so no HTML parser runs in Python.

Defined results: a null page has no cards and no items; text loses its tags and the named entities below; a repeated page
gives its rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offersieve.functions import text as X

# The fields of a card that its siblings must agree on, and the markers that frame them.
FIELDS = ["title", "price", "temperature", "image", "store"]
STAMP, LEVEL, IMAGE = "deal-card-stamp", "data-temperature-level", "deal-card-image"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]

_ANCHOR = r'<a\b[^>]*?\bhref="[^"]*/d/[^"]*"'
_PARTS = "array<struct<name:string,url:string,`@id`:string>>"
_ROOT = f"struct<mainEntity:struct<`@type`:string,hasPart:{_PARTS}>>"


def plain(html: Column) -> Column:
    """Text without tags, with single spaces."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for name, to in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def absolute(url: Column, origin: str) -> Column:
    """Paths against the origin; null for other than http(s)."""
    full = F.when(url.startswith("/"), F.concat(F.lit(origin), url)).otherwise(url)
    return F.when(full.rlike("^https?://"), full)


def best_of_srcset(srcset: Column) -> Column:
    """The candidate of the largest width; the first one, if several are."""
    found = F.split(srcset, r",\s+")
    rows = F.transform(found, lambda c, i: F.struct(F.regexp_extract(c, r"\s(\d+)w\s*$", 1).try_cast("int").alias("w"), (-i).alias("i"), F.regexp_extract(c, r"^\s*(\S+)", 1).alias("url")))
    return F.array_max(F.filter(rows, lambda r: r["w"].isNotNull()))["url"]


def cards(pages: DataFrame, origin: str, stores: str, page: str = "page_id", html: str = "html") -> DataFrame:
    """page, url, id and FIELDS of each rendered card. `stores` is how the path of a store's anchor begins."""
    stretch = F.regexp_extract_all(F.col(html), F.lit(rf"(?s){_ANCHOR}.*?(?={_ANCHOR}|\z)"), F.lit(0))
    c = pages.select(F.col(page).alias("page"), F.explode(stretch).alias("c"))
    get = lambda rx: F.regexp_extract("c", rx, 1)
    img = get(rf'(?s)(<img\b[^>]*class="[^"]*{IMAGE}[^"]*"[^>]*>)')
    return c.select(
        "page",
        X.canonical_url(absolute(F.trim(get(r'^<a\b[^>]*?\bhref="([^"]*)"')), origin)).alias("url"),
        F.trim(get(r'^<a\b[^>]*?\bdata-deal-id="([^"]*)"')).alias("id"),
        plain(get(r"(?s)^<a\b[^>]*>(.*?)</a>")).alias("title"),
        plain(get(rf'(?s)<span\b[^>]*class="[^"]*{STAMP}[^"]*"[^>]*>(.*?)</span>')).alias("price"),
        F.regexp_extract(get(rf"(?s){LEVEL}[^>]*>(.*?)</"), r"-?\d+", 0).alias("temperature"),
        F.coalesce(best_of_srcset(F.regexp_extract(img, r'\bsrcset="([^"]*)"', 1)), F.regexp_extract(img, r'\bsrc="([^"]*)"', 1)).alias("image"),
        plain(get(rf'(?s)<a\b[^>]*href="{stores}[^"]*"[^>]*>(.*?)</a>')).alias("store"),
    )


def merged(card_rows: DataFrame) -> DataFrame:
    """page, url, id, FIELDS and conflict: siblings of one URL become one card. Cards with an id decide; the others fill
    in what those lack. A field conflicts where its smallest and largest value differ, so an aggregate holds two values
    however many siblings there are."""
    known = lambda c, when: F.when(when & (F.trim(c) != ""), F.trim(c))
    own, loose = F.col("id") != "", F.col("id") == ""
    aggs = [F.min(known("id", own)).alias("id"), F.max(known("id", own)).alias("id_")]
    for f in FIELDS:
        for tag, side in (("a", own), ("b", loose)):
            aggs += [F.min(known(f, side)).alias(f"{f}_{tag}"), F.max(known(f, side)).alias(f"{f}_{tag}_")]
    g = card_rows.filter(F.col("url").isNotNull() & (F.col("url") != "")).groupBy("page", "url").agg(*aggs)
    bad = F.col("id") != F.col("id_")
    for f in FIELDS:
        bad = bad | F.coalesce(F.col(f"{f}_a") != F.col(f"{f}_a_"), F.col(f"{f}_b") != F.col(f"{f}_b_"))
    return g.select("page", "url", "id", *[F.coalesce(f"{f}_a", f"{f}_b").alias(f) for f in FIELDS], F.coalesce(bad, F.lit(False)).alias("conflict"))


def listed(pages: DataFrame, origin: str, script: str = "feed-schema", page: str = "page_id", html: str = "html") -> DataFrame:
    """page, position, title, url of the items of each page's JSON-LD collection."""
    body = F.regexp_extract(html, rf'(?s)<script\b[^>]*id="{script}"[^>]*>(.*?)</script>', 1)
    part = F.from_json(body, _ROOT)["mainEntity"]
    items = pages.select(F.col(page).alias("page"), part.alias("e")).filter("e.`@type` = 'CollectionPage'").select("page", F.posexplode("e.hasPart").alias("at", "p"))
    url = F.coalesce(F.nullif(F.trim("p.url"), F.lit("")), F.trim(F.col("p.`@id`")))
    return items.select("page", (F.col("at") + 1).alias("position"), F.col("p").isNull().alias("no_object"), F.trim(F.coalesce("p.name", F.lit(""))).alias("title"), X.canonical_url(absolute(url, origin)).alias("url"))


def offers(pages: DataFrame, origin: str, stores: str, script: str = "feed-schema", page: str = "page_id", html: str = "html") -> DataFrame:
    """Items joined to their card by page and URL, each with the first reason to skip it, or none: page, position, id,
    title, text, price, url, temperature, image, skip_reason."""
    i = listed(pages, origin, script, page, html)
    c = merged(cards(pages, origin, stores, page, html)).withColumnRenamed("title", "shown").withColumn("has_card", F.lit(True))
    j = i.join(c, ["page", "url"], "left")
    path = F.regexp_extract("url", r"^[^:]+://[^/?]*([^?]*)", 1)
    reason = (
        F.when(F.col("no_object"), "item_not_object")
        .when(F.col("title") == "", "missing_title")
        .when(F.coalesce("url", F.lit("")) == "", "missing_url")
        .when(~path.startswith("/d/"), "non_deal_item")
        .when(F.col("conflict"), "conflicting_duplicate_card")
        .when(F.col("has_card").isNull(), "missing_rendered_card")
        .when(F.coalesce("id", F.lit("")) == "", "missing_id")
        .when(F.coalesce("temperature", F.lit("")) == "", "missing_temperature")
        .when((F.coalesce("shown", F.lit("")) != "") & (F.col("shown") != F.col("title")), "title_mismatch")
    )
    text = F.when(F.coalesce("store", F.lit("")) != "", F.concat(F.lit("Vendido por "), "store")).otherwise(F.lit(""))
    return j.select("page", "position", "id", "title", text.alias("text"), X.offer_price(F.col("price")).alias("price"), "url", F.col("temperature").try_cast("int").alias("temperature"), absolute(F.col("image"), origin).alias("image"), reason.alias("skip_reason"))


def skips(offer_rows: DataFrame, examples: int = 3) -> DataFrame:
    """page, skip_reason, n, and the first few positions, comma-joined."""
    w = Window.partitionBy("page", "skip_reason").orderBy("position")
    g = offer_rows.filter("skip_reason IS NOT NULL").select("page", "skip_reason", "position").withColumn("no", F.row_number().over(w)).groupBy("page", "skip_reason")
    first = F.array_sort(F.collect_list(F.when(F.col("no") <= examples, F.col("position"))))
    return g.agg(F.count("*").alias("n"), F.array_join(first, ",").alias("first"))


def details(pages: DataFrame, url: str = "url", html: str = "html", most: int = 500) -> DataFrame:
    """url, detail_price, comment of offer pages: the first JSON-LD block that has a price (of its offer, or its own) and
    the first that has a description; null where none has."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<script\b[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    prices = F.transform(blocks, lambda b: F.coalesce(*[F.get_json_object(b, p) for p in ("$.offers.price", "$.offers[0].price", "$.price", "$.mainEntity.offers.price")]))
    said = F.transform(blocks, lambda b: F.coalesce(*[F.get_json_object(b, p) for p in ("$.description", "$.mainEntity.description")]))
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(0))
    return pages.select(X.canonical_url(F.col(url)).alias("url"), X.offer_price(first(prices)).alias("detail_price"), F.rtrim(F.left(plain(first(said)), F.lit(most))).alias("comment"))


def enriched(offer_rows: DataFrame, details: DataFrame) -> DataFrame:
    """Offers with what their detail page (url, detail_price, comment) adds: a price where there is none, and the comment
    where the text does not hold it yet. Of several details of a URL the smallest pair counts."""
    d = details.groupBy("url").agg(F.min(F.struct("detail_price", "comment")).alias("d"))
    say = F.coalesce("d.comment", F.lit(""))
    add = F.trim(F.concat_ws("\n", F.nullif("text", F.lit("")), say))
    text = F.when((say == "") | F.col("text").contains(say), F.col("text")).otherwise(add)
    return offer_rows.join(d, "url", "left").withColumns({"price": F.coalesce("price", "d.detail_price"), "text": text}).drop("d")
