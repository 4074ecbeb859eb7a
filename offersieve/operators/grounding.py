"""Checks of what a model extracted, verified, translated or rewrote, as codes of the first fault; and the card built of it.
Column expressions over parsed JSON, one pass a row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from offersieve.functions import present as V
from offersieve.functions import text as X

# Fields of an offer, categories with their signs, languages, and words that a reason must not show.
FACTS = ["product_name", "current_price", "original_price", "payment_terms", "seller", "availability", "deal_callout"]
CATEGORIES = {
    "electronics": "⚡", "fashion": "👟", "home": "🏠", "beauty": "✨", "grocery": "🛒",
    "games": "🎮", "books": "📚", "travel": "✈️", "services": "🔧", "other": "🏷️",
}
LANGUAGES = ["pt-BR", "en", "es", "fr", "de", "it", "unknown"]
INTERNAL = r"(?i)\b(?:pipeline|prompt|gemini|model|filter|score|profile|stage)\b"
COUPON = "^[A-Za-z0-9_-]{1,40}$"
#: Most offers, links of an offer or of all, coupons and highlights; characters of a caption.
OFFERS, LINKS, ITEMS, CAPTION = 3, 3, 5, 1024

_GROUNDED = "struct<value:string,evidence:string>"
_OFFER = ",".join([*(f"{f}:{_GROUNDED}" for f in FACTS), f"coupons:array<{_GROUNDED}>", f"highlights:array<{_GROUNDED}>", "category:string", "link_ids:array<string>"])
EXTRACTION = f"struct<prompt_injection_detected:boolean,source_language:string,offers:array<struct<{_OFFER}>>>"


def _bad_text(text: Column, most: int) -> Column:
    return text.isNull() | V.plain_fault(text, most).isNotNull()


def _grounding(g: Column, source: Column, most: int) -> Column:
    """Fault of one value with its evidence."""
    return F.when(_bad_text(g["value"], most) | _bad_text(g["evidence"], 300), F.lit("field")).when(~F.contains(source, V.plain(g["evidence"])), F.lit("ungrounded"))


def _first(faults: Column) -> Column:
    return F.get(F.filter(faults, lambda f: f.isNotNull()), F.lit(0))


def _items(items: Column, source: Column, most: int, kind: str) -> Column:
    """Fault of a list of values with evidence."""
    wrong = F.when(items.isNull() | (F.size(items) > ITEMS) | F.exists(items, lambda g: g.isNull()), F.lit(kind))
    return F.coalesce(wrong, _first(F.transform(items, lambda g: _grounding(g, source, most))))


def _offer_fault(offer: Column, source: Column, links: Column) -> Column:
    facts = [F.when(offer[f].isNotNull(), _grounding(offer[f], source, 200)) for f in FACTS]
    prices = [F.when(offer[f].isNotNull() & V.shown_price(V.plain(offer[f]["value"])).isNull(), F.lit("price")) for f in ("current_price", "original_price")]
    codes = F.transform(offer["coupons"], lambda g: V.plain(g["value"]))
    chosen = offer["link_ids"]
    return F.coalesce(
        F.when(offer.isNull(), F.lit("shape")),
        F.when(~F.coalesce(offer["category"].isin(list(CATEGORIES)), F.lit(False)), F.lit("category")),
        *facts,
        F.when(offer["product_name"].isNull(), F.lit("product")),
        *prices,
        _items(offer["coupons"], source, 40, "coupons"),
        F.when(F.exists(codes, lambda c: ~c.rlike(COUPON)) | (F.size(F.array_distinct(F.transform(codes, F.lower))) < F.size(codes)), F.lit("coupons")),
        _items(offer["highlights"], source, 160, "highlights"),
        F.when(chosen.isNull() | (F.size(chosen) > LINKS) | (F.size(F.array_distinct(chosen)) < F.size(chosen)), F.lit("links")),
        F.when(F.exists(chosen, lambda i: F.coalesce(~F.array_contains(links, i), F.lit(True))), F.lit("links")),
    )


def extraction_fault(raw: Column, source: Column, links: Column) -> Column:
    """The first fault of an extraction as JSON text, against the text that it was made from and the ids of the links
    that it may choose; null if there is none."""
    # the text is made, parsed and asked for its keys once each, however often the checks name them
    return X._with(raw, lambda r: X._with(F.struct(r.alias("raw"), F.from_json(r, EXTRACTION).alias("x"), source.alias("source")), lambda v: _extraction_fault(v["raw"], v["x"], v["source"], links)))


def _extraction_fault(raw: Column, x: Column, source: Column, links: Column) -> Column:
    offers = x["offers"]
    exact = F.array_sort(F.json_object_keys(raw)) == F.array(*(F.lit(k) for k in ("offers", "prompt_injection_detected", "source_language")))
    return F.coalesce(
        F.when(~F.coalesce(exact, F.lit(False)) | x["prompt_injection_detected"].isNull(), F.lit("shape")),
        F.when(~F.coalesce(x["source_language"].isin(LANGUAGES), F.lit(False)), F.lit("language")),
        F.when(offers.isNull() | ~F.size(offers).between(1, OFFERS), F.lit("offer_count")),
        _first(F.transform(offers, lambda o: _offer_fault(o, source, links))),
        F.when(F.size(F.array_distinct(F.flatten(F.transform(offers, lambda o: o["link_ids"])))) > LINKS, F.lit("links")),
    )


def verification_fault(verdicts: Column, present: Column) -> Column:
    """The name of the first field that is present but not supported, without valid evidence, or in conflict. Verdicts are
    an array of structs of name, supported, evidence_valid and conflicting; null in any of these is a fault of its own."""
    open_ = F.exists(verdicts, lambda v: v["supported"].isNull() | v["evidence_valid"].isNull() | v["conflicting"].isNull())
    bad = F.filter(verdicts, lambda v: F.array_contains(present, v["name"]) & (~v["supported"] | ~v["evidence_valid"] | v["conflicting"]))
    return F.when(open_, F.lit("not_boolean")).otherwise(F.get(bad, F.lit(0))["name"])


def localization_fault(fact: dict[str, Column], local: dict[str, Column]) -> Column:
    """The first fault of translated fields: no plain text, a field that came or went, another seller, or another number
    of highlights."""
    most = {"product_name": 200, "availability": 180, "seller": 200, "deal_callout": 160, "payment_terms": 120}
    unlike = F.coalesce(F.size(local["highlights"]), F.lit(-1)) != F.size(fact["highlights"])
    return F.coalesce(
        *(F.when(V.plain_fault(local[f], n).isNotNull(), F.lit(f"field:{f}")) for f, n in most.items()),
        F.when(unlike, F.lit("highlights")),
        F.when(F.exists(local["highlights"], lambda h: _bad_text(h, 160)), F.lit("field:highlights")),
        *(F.when(fact[f].isNull() != local[f].isNull(), F.lit(f"presence:{f}")) for f in most),
        F.when(~V.plain(local["seller"]).eqNullSafe(fact["seller"]), F.lit("seller")),
    )


def reason_fault(reason: Column) -> Column:
    """Why a rewritten reason can't be shown: no plain text, more than one sentence, or internal words."""
    p = V.plain(reason)
    ends = F.regexp_count(p, F.lit(r"[.!?](?:\s|$)"))
    fault = F.when(reason.isNull(), F.lit("empty_or_oversized")).otherwise(V.plain_fault(reason, 240))
    return F.coalesce(fault, F.when(ends > 1, F.lit("not_one_sentence")), F.when(p.rlike(INTERNAL), F.lit("internal_words")))


def _said(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _lines(*lines: Column | str) -> Column:
    return F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))


def _offer_lines(o: Column, language: str, highlights: bool, seller: bool, availability: bool) -> Column:
    pt = language == "pt-BR"
    none = F.array().cast("array<string>")
    only = lambda ok, lines: F.when(ok, lines).otherwise(none)
    name = F.when(_said(o["product_name"]), o["product_name"]).otherwise("Promoção" if pt else "Promotion")
    shown = [F.when(o[p].isNotNull(), X.money(o[p], language)) for p in ("current_price", "original_price")]
    off = F.concat(X.discount_percent(o["current_price"], o["original_price"]).cast("string"), F.lit("% OFF"))
    callout = F.concat_ws(" · ", off, F.nullif(o["deal_callout"], F.lit("")))
    many = F.size(o["coupons"]) > 1
    label = F.when(many, "🎟️ Cupons" if pt else "🎟️ Coupons").otherwise("🎟️ Cupom" if pt else "🎟️ Coupon")
    use = F.when(many, "Aplique um código no carrinho" if pt else "Apply one code at checkout").otherwise("Aplique no carrinho" if pt else "Apply at checkout")
    parts = [
        _lines(F.concat(F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv)), o["category"]), F.lit(" "), name)),
        only(_said(o["availability"]), _lines(o["availability"])) if availability else none,
        _lines(""),
        only(reduce(or_, (s.isNotNull() for s in shown)), _lines(F.concat_ws("   ", *shown))),
        only(_said(o["payment_terms"]), _lines(o["payment_terms"])),
        only(callout != "", _lines(callout)),
        only(F.size(o["coupons"]) > 0, F.concat(_lines("", label), o["coupons"], _lines(use))),
        only(_said(o["seller"]), _lines("", F.concat(F.lit("🏪 "), o["seller"]))) if seller else none,
        only(F.size(o["highlights"]) > 0, F.concat(_lines(""), F.transform(o["highlights"], lambda h: F.concat(F.lit("• "), h)))) if highlights else none,
    ]
    return F.concat(*parts)


def _card_lines(offers: Column, language: str, kept: tuple[bool, bool, bool]) -> Column:
    """All lines, an empty one between offers."""
    apart = lambda i: F.when(i > 0, _lines("")).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(offers, lambda o, i: F.concat(apart(i), _offer_lines(o, language, *kept))))


def localized_card(offers: Column, reason: Column, language: str = "pt-BR") -> Column:
    """The fullest card that fits a caption: highlights go first, then the seller, then availability; null if none fits.
    Offers are an array of structs of the facts (prices as decimals), category, coupons and highlights (never null)."""
    out = []
    for kept in ((True, True, True), (False, True, True), (False, False, True), (False, False, False)):
        text = F.regexp_replace(F.concat_ws("\n", F.array_join(_card_lines(offers, language, kept), "\n"), F.lit(""), reason), r"\n+$", "")
        out.append(F.when(F.length(text) <= CAPTION, text))
    return F.coalesce(*out)
