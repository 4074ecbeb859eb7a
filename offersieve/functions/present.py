"""Columns that shape and check what is shown, and short ids. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offersieve.functions import text as X

SPACE = r"[\s\x1c-\x1f\x85\xa0]+"
# What generated text must not hold, and commands it must not give.
MARKUP = r"(?i)https?://|<[^>]*>|&(?:#[0-9]+|#x[0-9a-f]+|[a-z]+);"
COMMAND = r"(?i)^/|(?:^|\s)/(?:start|help|admin|system)\b"
SHOWN_PRICE = r"(?i)^(?:(?:r\$|brl)\s*)?(?:[0-9]{1,3}(?:[.\s][0-9]{3})*(?:,[0-9]{1,2})?|[0-9]+(?:[.,][0-9]{1,2})?)$"
#: Of delays after a refused request: first step, ceiling, most doublings.
STEP, CEILING, DOUBLINGS = 30.0, 300.0, 4
#: Of links shown and of a digest's JSON.
MOST_LINKS = 5


def without_controls(text: Column, keep_newlines: bool = False) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f]" if keep_newlines else r"[\x00-\x1f\x7f]", "")


def plain(text: Column) -> Column:
    """Without control characters, each run of white space one space."""
    return F.trim(F.regexp_replace(without_controls(text), SPACE, " "))


def plain_fault(text: Column, maximum: int) -> Column:
    """Why a field is not plain text; null if it is, or is null."""
    p = plain(text)
    out = F.when(text.isNull(), None).when((p == "") | (F.length(p) > maximum), F.lit("empty_or_oversized"))
    return out.when(p.rlike(MARKUP), F.lit("url_or_markup")).when(p.rlike(COMMAND), F.lit("command"))


def chunks(text: Column, maximum: int = 4096, empty: str = "Promotion") -> Column:
    """Stretches of `maximum` characters; of nothing, one fixed word."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / maximum).cast("int")), lambda i: F.substring(text, i * maximum + 1, F.lit(maximum)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit(empty))).otherwise(cut)


def clean(text: Column, maximum: int = 700) -> Column:
    """One line of at most `maximum` characters, an ellipsis for the rest, with markup escaped."""
    x = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    x = F.when(F.length(x) > maximum, F.concat(F.rtrim(F.substring(x, 1, maximum - 1)), F.lit("…"))).otherwise(x)
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(c), F.lit(e))
    return x


def code(text: Column) -> Column:
    return F.concat(F.lit("<code>"), clean(text, 180), F.lit("</code>"))


def shaped_reason(text: Column, most: int = 240) -> Column:
    """The first sentence, in one line, of at most `most` characters; null if there is none."""
    x = F.trim(F.regexp_replace(text, SPACE, " "))
    first = F.trim(F.coalesce(F.nullif(F.regexp_extract(x, r"^(.*?[.!?])(?:\s|$)", 1), F.lit("")), x))
    return F.nullif(F.when(F.length(first) > most, F.concat(F.rtrim(F.substring(first, 1, most - 3)), F.lit("..."))).otherwise(first), F.lit(""))


def shown_price(text: Column) -> Column:
    """The price that a field is, whole; null unless it is one and above zero."""
    price = F.when(text.rlike(SHOWN_PRICE), X.parse_price(text))
    return F.when(price > 0, price)


def detail_url(url: Column, host: str, prefix: str = "/d/") -> Column:
    """The canonical URL of a detail page at this host; null for any other, for another port, and with a user name."""
    u = X.canonical_url(url)
    host, prefix = (x.replace(".", r"\.") for x in (host, prefix))
    return F.when(u.rlike(rf"^https://{host}(?::443)?{prefix}[^?]"), u)


def link_candidates(*urls: Column) -> Column:
    """The first MOST_LINKS distinct valid URLs of the arrays, in order, as structs of id and url."""
    cleaned = F.transform(F.concat(*(F.coalesce(u, F.array().cast("array<string>")) for u in urls)), lambda u: F.trim(without_controls(u)))
    valid = F.filter(cleaned, lambda u: u.rlike(r"(?i)^https?://[^\s/?#@]+(?:[/?#]\S*)?$"))
    return F.transform(F.slice(F.array_distinct(valid), 1, MOST_LINKS), lambda u, i: F.struct(F.concat(F.lit("link_"), (i + 1).cast("string")).alias("id"), u.alias("url")))


def offer_digest(title: Column, text: Column, price: Column, links: Column) -> Column:
    """Digest of compact JSON with sorted keys, nulls written."""
    whole = F.struct(links.alias("link_candidates"), price.cast("string").alias("price"), text.alias("text"), title.alias("title"))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def short_id(length: int, *parts: Column) -> Column:
    """The first digits of a digest of parts, apart by a null character."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)


def image_type(data: Column) -> Column:
    """Type of a still image by its first bytes; null for anything else, an animated one included."""
    head = F.hex(F.substring(data, 1, 16))
    moving = F.hex(F.substring(data, 1, 4096)).rlike("^(?:..)*?(?:414E494D|414E4D46)")
    out = F.when(head.startswith("FFD8FF"), F.lit("image/jpeg")).when(head.startswith("89504E470D0A1A0A"), F.lit("image/png"))
    return out.when((F.length(data) >= 16) & head.rlike("^52494646.{8}57454250") & ~moving, F.lit("image/webp"))


def duration_seconds(text: Column) -> Column:
    """Seconds of `12.5s`; null for other forms and for negative ones."""
    return F.nullif(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)s\s*$", 1), F.lit("")).cast("double")


def rate_limit_delay(told: Column, also_told: Column, failures: Column, share: Column) -> Column:
    """Seconds to wait: the longest that the provider tells, else STEP doubled with every failure, and up to a quarter
    more by a share of 0 to 1."""
    said = F.greatest(F.when(told > 0, told), F.when(also_told > 0, also_told))
    base = F.least(F.lit(CEILING), F.lit(STEP) * F.pow(F.lit(2.0), F.least(failures, F.lit(DOUBLINGS))))
    return F.coalesce(said, F.least(F.lit(CEILING), base + share * F.least(F.lit(STEP), base * 0.25)))


def request_stage(purpose: Column) -> Column:
    """The budget that a request counts towards."""
    return F.when(purpose.startswith("preference_"), F.lit("preference")).when(purpose == "evaluation", F.lit("evaluation")).otherwise(F.lit("presentation"))


def error_decision(outcome: Column, queued: Column, kind: Column) -> tuple[Column, Column]:
    """Decision and reason after a failed evaluation: budget, retryable (queued or not), or permanent."""
    retry = outcome == "retryable"
    decision = F.when(retry & queued, F.lit("retry")).otherwise(F.lit("discard"))
    reason = F.when(outcome == "daily_budget", F.lit("llm_daily_budget_exhausted")).when(retry & queued, F.lit("llm_retry_queued")).when(retry, F.lit("llm_retry_queue_full"))
    return decision, reason.otherwise(F.concat(F.lit("llm_permanent_error:"), kind))
