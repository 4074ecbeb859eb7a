"""Plain item lists of feeds: a list at the top of the document, or in the one member of its graph that has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.functions import text as X

ITEMS = "array<variant>"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column, path: str) -> Column:
    """A value as text; null if it is missing, null or empty."""
    return F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def _listed(v: Column, path: str) -> Column:
    """An array, or a single object as an array of it."""
    one = F.try_variant_get(v, path, "variant")
    return F.when(_is(one, "ARRAY"), F.try_variant_get(v, path, ITEMS)).when(_is(one, "OBJECT"), F.array(one))


def _temperature(product: Column, entry: Column) -> Column:
    """The first of several places that holds a number, by its first digits."""
    properties = F.coalesce(_listed(product, "$.additionalProperty"), F.array().cast(ITEMS))
    named = F.filter(properties, lambda p: F.lower(F.coalesce(_text(p, "$.name"), F.lit(""))).contains("temperatura"))
    places = F.array(_text(product, "$.temperature"), _text(product, "$.heat"), _text(entry, "$.temperature"), _text(product, "$.aggregateRating.ratingValue"))
    said = F.concat(places, F.transform(named, lambda p: _text(p, "$.value")))
    digits = F.transform(said, lambda t: F.regexp_extract(t, r"(-?\d+)", 1))
    return F.get(F.filter(digits, lambda d: F.coalesce(d, F.lit("")) != ""), F.lit(0)).try_cast("int")


def items(pages: DataFrame, raw: str, *keys: str) -> DataFrame:
    """keys, position, skip_reason (null for an offer), id, title, text, url, price, temperature and published (null if not
    told) of each item; a document without an item list gives no rows."""
    root = F.try_parse_json(F.col(raw))
    members = F.transform(F.try_variant_get(root, '$["@graph"]', ITEMS), lambda m: F.try_variant_get(m, "$.itemListElement", ITEMS))
    members = F.filter(members, lambda m: m.isNotNull())
    found = F.coalesce(F.try_variant_get(root, "$.itemListElement", ITEMS), F.when(F.size(members) == 1, F.get(members, F.lit(0))))
    entry = pages.select(*keys, F.posexplode(found).alias("position", "entry"))
    inner = F.try_variant_get("entry", "$.item", "variant")
    entry = entry.withColumn("product", F.when(_is(F.col("entry"), "OBJECT"), F.coalesce(inner, "entry")))
    offer = F.try_variant_get("product", "$.offers", "variant")
    entry = entry.withColumn("offer", F.when(_is(offer, "ARRAY"), F.try_variant_get("product", "$.offers[0]", "variant")).otherwise(offer))
    p, o = F.col("product"), F.col("offer")
    dated = F.coalesce(_text(p, "$.datePublished"), _text(p, "$.dateCreated"))
    url = F.coalesce(_text(p, "$.url"), _text(o, "$.url"))
    out = entry.select(
        *keys, "position", "entry", "product", "offer", dated.alias("dated"), _text(p, "$.name").alias("title"), url.alias("url"),
        F.coalesce(_text(p, "$.description"), F.lit("")).alias("text"), X.offer_price(_text(o, "$.price")).alias("price"),
        _temperature(p, F.col("entry")).alias("temperature"), dated.try_cast("timestamp").alias("published"),
        F.coalesce(_text(p, "$.productID"), _text(p, "$.sku"), _text(p, '$["@id"]'), F.substring(F.sha2(url, 256), 1, 24)).alias("id"),
    )
    # Reasons, in the order in which they are asked.
    asked = [
        ("item_not_object", ~_is(F.col("entry"), "OBJECT")),
        ("missing_product", ~_is(F.col("product"), "OBJECT")),
        ("missing_offer", ~_is(F.col("offer"), "OBJECT")),
        ("missing_title", F.col("title").isNull()),
        ("missing_url", F.col("url").isNull()),
        ("missing_temperature", F.col("temperature").isNull()),
        ("invalid_timestamp", F.col("dated").isNotNull() & F.col("published").isNull()),
    ]
    reason = F.coalesce(*(F.when(fault, F.lit(name)) for name, fault in asked))
    return out.select(*keys, "position", reason.alias("skip_reason"), "id", "title", "text", "url", "price", "temperature", "published")
