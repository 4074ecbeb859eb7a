"""Text, price, URL and hash columns. Every function takes and gives Spark columns; nothing leaves the JVM except
`fold_any`, for text outside the range that `translate` covers."""

from __future__ import annotations

import re
import unicodedata

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

def fold_py(text: str) -> str:
    """Compatibility composition, case folding, and no combining marks."""
    x = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in x if not unicodedata.combining(c))


_FOLDED = {c: fold_py(c) for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000)))}
#: Characters that fold to one ASCII character, and those that fold to nothing (marks).
MARKED = "".join(c for c, x in _FOLDED.items() if len(x) == 1 and x.isascii()) + "".join(c for c, x in _FOLDED.items() if not x)
PLAIN = "".join(x for x in _FOLDED.values() if len(x) == 1 and x.isascii())
#: Lower-case characters that fold to several, of which at least one is kept or read by normalisation: ligatures, Roman
#: numerals, fractions, units, the ellipsis, letters and numbers in brackets.
SEVERAL = {c: x for c, x in _FOLDED.items() if len(x) > 1 and re.search(r"[a-z0-9_.,%$:/<>]", x) and c == c.lower()}
#: Lower-case Latin-1 letters: texts whose other characters are all ASCII need no table of characters.
LATIN = {c: x for c, x in _FOLDED.items() if c <= "\xff" and x.isalpha() and x.isascii() and c == c.lower() and c.isalpha() and c not in "\xaa\xb5\xba"}


def _ranges(chars: list[int], gap: int) -> list[tuple[int, int]]:
    """Code points as ranges; above Latin letters those at most `gap` apart are one, so that the class stays short."""
    out: list[tuple[int, int]] = []
    for c in chars:
        if out and c - out[-1][1] <= (gap if c >= 0x250 else 1):
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


_AT = _ranges(sorted(map(ord, SEVERAL)), 256)
_class = lambda ranges: "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
_NEAR, _REST = _class(_AT), _class(list(zip([0, *(b + 1 for _, b in _AT)], [*(a - 1 for a, _ in _AT), 0x10FFFF], strict=True)))

# Connector words that carry no meaning of their own.
CONNECTORS = ["and", "com", "da", "das", "de", "do", "dos", "em", "for", "na", "nas", "no", "nos", "of", "para", "por", "sem", "the", "with"]


def _with(value: Column, f) -> Column:
    """f(value), with the value made once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _any_of(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands anywhere in the text: a scan of bytes, far cheaper than an expression."""
    return reduce(or_, [text.contains(w) for w in words])


def fold(text: Column) -> Column:
    """Lower case without accents, as far as normalisation reads it: every character that folds to ASCII does. ASCII texts
    are left as they are; of others the Latin-1 letters are replaced first, and only what is no ASCII then meets the table."""
    plain = lambda x: F.octet_length(x) == F.length(x)
    latin = lambda x: _with(_looked_up(x, r"[\x{80}-\x{10FFFF}]", r"[\x00-\x7F]", LATIN), lambda y: F.when(plain(y), y).otherwise(_fold_all(y)))
    return _with(F.lower(text), lambda x: F.when(plain(x), x).otherwise(latin(x)))


def _looked_up(x: Column, sign: str, rest: str, table: dict[str, str]) -> Column:
    """x cut at every `sign`, each replaced as the table says; what the table lacks stays. `sign` and `rest` are classes that
    hold all characters between them, so one scan serves a table of any size."""
    to = F.str_to_map(F.lit("\n".join(f"{c}\t{y}" for c, y in table.items())), F.lit("\n"), F.lit("\t"))  # folded to a constant
    one = lambda part: F.when(F.length(part) == 1, F.coalesce(F.try_element_at(to, part), part)).otherwise(part)
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f"{sign}|{rest}+"), F.lit(0)), one), "")


def _fold_all(x: Column) -> Column:
    """Of lower-case texts: those with a character near those that fold to several are cut there, and each is looked up; others
    go straight to `translate`."""
    x = F.when(x.rlike(_NEAR), _looked_up(x, _NEAR, _REST, SEVERAL)).otherwise(x)
    return F.translate(x, MARKED, PLAIN)


def fold_any(text: Column) -> Column:
    """The same in Python, and for all other signs too."""
    return F.pandas_udf(lambda values: values.map(fold_py, na_action="ignore"), "string")(text)


def normalize(text: Column, fold_with=fold) -> Column:
    """Folded text of [a-z0-9_.] words: URLs become `url`, percentages `N percent`, currencies `brl` and `usd`. Steps on
    signs that few texts have are left out where the sign is not there."""
    where = lambda x, signs, f: _with(x, lambda y: F.when(_any_of(y, signs), f(y)).otherwise(y))
    x = fold_with(F.coalesce(text, F.lit("")))
    x = where(x, ["://"], lambda y: F.regexp_replace(y, r"https?://[^\s<>]+", " url "))
    x = where(x, ["%"], lambda y: F.regexp_replace(y, r"(\d{1,3}(?:[.,]\d+)?)\s*%", " $1 percent "))
    x = where(x, ["r$"], lambda y: F.regexp_replace(y, r"r\$\s*", " brl "))
    x = where(x, ["us$", "usd"], lambda y: F.regexp_replace(y, r"us(?<=\bus)(?:\$|d\b)", " usd "))
    x = F.regexp_replace(x, r",(?<=\d,)(?=\d)", ".")
    # what is not [a-z0-9_.]: Java takes ten times longer for the negated class
    return F.trim(F.regexp_replace(x, r"[\x00-\-/:-^`{-\x{10FFFF}]+", " "))


def tokens(normal: Column) -> Column:
    """Words of normal text. Without `_` they are what stands between spaces and dots."""
    said = lambda x: F.when(x.contains("_"), F.regexp_extract_all(x, F.lit(r"[a-z0-9]+(?:_[a-z0-9]+)*"), F.lit(0))).otherwise(_parts(x, "."))
    return _with(normal, said)


def _parts(x: Column, signs: str) -> Column:
    """What stands between spaces and these signs."""
    return F.array_remove(F.split(reduce(lambda y, c: F.replace(y, F.lit(c), F.lit(" ")), signs, x), " "), "")


def significant(token_list: Column) -> Column:
    """Tokens parted at `_` and between letters and digits, without connectors; order and repeats stay."""
    parts = F.flatten(F.transform(token_list, lambda t: F.regexp_extract_all(t, F.lit(r"[a-z]+|[0-9]+"), F.lit(0))))
    return F.filter(parts, lambda t: ~t.isin(CONNECTORS))


def significant_of(normal: Column) -> Column:
    """The same from normal text, whose runs of letters or digits are those of its tokens: digits are set apart, then it
    is what stands between spaces and signs."""
    return F.filter(_parts(F.regexp_replace(normal, "[0-9]+", " $0 "), "._"), lambda t: ~t.isin(CONNECTORS))


def normal_py(text: str) -> str:
    """`normalize` for the few values of a rule or a profile, on the driver."""
    x = re.sub(r"https?://[^\s<>]+", " url ", fold_py(text))
    x = re.sub(r"([0-9]{1,3}(?:[.,][0-9]+)?)\s*%", r" \1 percent ", x)
    x = re.sub(r"\bus\$|\busd\b", " usd ", re.sub(r"r\$\s*", " brl ", x), flags=re.ASCII)
    x = re.sub(r"(?<=[0-9]),(?=[0-9])", ".", re.sub(r"[^a-z0-9_.,]+", " ", x))
    return re.sub(r"[^a-z0-9_.]+", " ", x).strip()


def significant_py(text: str) -> list[str]:
    parts = [p for t in re.findall(r"[a-z0-9_]+", normal_py(text)) for p in re.findall(r"[a-z]+|[0-9]+", t)]
    return [p for p in parts if p not in CONNECTORS]


def marker_py(text: str) -> str:
    return "_".join(re.findall(r"[a-z0-9]+", normal_py(text)))


# What a number and a stated price look like.
_NUMBER = r"(\d{1,3}(?:[.\s]\d{3})+(?:,\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
_STATED = r"(?i)((?:r\$|brl|us\$|usd|\$)\s*\d[\d.,\s]*|\bpor\s+(?:apenas\s+)?\d[\d.,\s]*|\d[\d.,\s]*\s+reais\b)"


def parse_price(text: Column) -> Column:
    """The first number: with a comma the dots are thousands; several dots, or one before exactly three digits, are too."""
    found = F.regexp_replace(F.regexp_extract(text, _NUMBER, 1), r"\s", "")
    plain = F.when(found.contains(","), F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    plain = plain.when((F.length(found) - F.length(F.replace(found, F.lit("."), F.lit(""))) > 1) | found.rlike(r"^\d+\.\d{3}$"), F.replace(found, F.lit("."), F.lit("")))
    return plain.otherwise(F.nullif(found, F.lit(""))).try_cast("decimal(18,2)")


def stated_price(text: Column) -> Column:
    """The price that a sentence states: after `de ... por`, else beside a currency, `por` or `reais`."""
    after = F.nullif(F.regexp_extract(text, r"(?i)\bde\b[^\n]{0,80}?\bpor\b([^\n]{0,80})", 1), F.lit(""))
    beside = F.nullif(F.regexp_extract(text, _STATED, 1), F.lit(""))
    return F.coalesce(parse_price(after), parse_price(beside))


def offer_price(text: Column) -> Column:
    """A card's price: null for a free offer, for a coupon, and where a letter follows the number."""
    t = F.trim(text)
    free = F.lower(t).rlike(r"gr[aá]tis|\bfree\b")
    whole = t.rlike(r"^[\d.,]+$")
    amount = F.nullif(F.regexp_extract(t, r"(?i)(?:r\$|brl)\s*([\d.,]*\d)(?![\d.,]*[\p{L}])", 1), F.lit(""))
    return F.when(free, F.lit(None).cast("decimal(18,2)")).when(whole, parse_price(t)).otherwise(parse_price(amount))


def stated_discount(normal: Column) -> Column:
    """From normal text, the first percentage next to a word for a discount, above 0 and at most 100."""
    # The two forms, number last or number first.
    form = r"\b(?:desconto|discount|off|economize)\b[^\d]{0,12}(\d{1,3}(?:[.,]\d+)?)\s*(?:%|percent)\b|(\d{1,3}(?:[.,]\d+)?)\s*(?:%|percent)\s*(?:de\s+)?(?:desconto|discount|off)\b"
    # words that every match holds
    may = _any_of(normal, ["percent", "%"]) & _any_of(normal, ["desconto", "discount", "off", "economize"])
    either = F.when(may, F.coalesce(F.nullif(F.regexp_extract(normal, form, 1), F.lit("")), F.nullif(F.regexp_extract(normal, form, 2), F.lit(""))))
    n = F.replace(either, F.lit(","), F.lit(".")).try_cast("double")
    return F.when((n > 0) & (n <= 100), n)


def _decoded(x: Column) -> Column:
    plus = F.replace(x, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(F.replace(plus, F.lit(" "), F.lit("%20"))), plus)


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, fragment or tracking parameter; the order of the others stays, and
    each is written as key=value, encoded anew. Space around goes, and null is empty."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", "")
    part = lambda g: F.regexp_extract(url, r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", g)
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), _decoded(F.regexp_replace(p, r"^[^=]*=", ""))).otherwise(F.lit("")).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).rlike(r"^(?:utm_[\s\S]*|fbclid|gclid|ref|referrer|source)$"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    path = F.regexp_replace(part(3), r"/+$", "")
    head = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit("://"))).otherwise(F.lit(""))
    return F.concat(head, F.lower(part(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def content_hash(title: Column, text: Column, price: Column, urls: Column) -> Column:
    """Digest of what an offer says: normal text, price (zero as none) and canonical URLs, apart by a unit separator."""
    money = F.when(price.isNull() | (price == 0), F.lit("")).otherwise(price.cast("string"))
    said = normalize(F.concat_ws(" ", title, text, F.when(price.isNotNull(), F.concat(F.lit("brl "), price.cast("string")))))
    return F.sha2(F.concat_ws("\x1f", said, money, F.transform(urls, canonical_url)), 256)


def hash_share(digest: Column) -> Column:
    """A digest's first 16 hex digits as a share of 1, for sampling by hash."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float((1 << 64) - 1))


def spaced(token_list: Column) -> Column:
    """Tokens as a text with a space before and after each."""
    return F.concat(F.lit(" "), F.array_join(token_list, " "), F.lit(" "))


def stands_in(spaced_text: Column, phrase: list[str]) -> Column:
    """Whether the phrase's tokens stand in a row in a spaced text."""
    return spaced_text.contains(f" {' '.join(phrase)} ")


def canonical_tokens(base: Column, groups: list[tuple[str, list[list[str]]]]) -> Column:
    """Tokens with alias groups drawn together. A group matches when all tokens of one of its variants are there; the
    tokens of every matching variant go, repeats of others stay, and each matching group adds its marker once."""
    if not groups:
        return base
    names = list(dict.fromkeys(t for _, variants in groups for v in variants for t in v))
    none = F.array().cast("array<string>")
    one_of = lambda conditions, value: F.when(reduce(or_, conditions), value)

    def drawn(base: Column, there: Column) -> Column:
        has = lambda v: reduce(and_, [there[names.index(t)] for t in v])
        within = {t: [has(v) for _, variants in groups for v in variants if t in v] for t in names}
        marks = [one_of([has(v) for v in variants if v], F.array(F.lit(m))).otherwise(none) for m, variants in groups if any(variants)]
        rest = reduce(lambda x, t: _with(x, lambda y: one_of(within[t], F.array_remove(y, t)).otherwise(y)), names, base)
        return F.concat(rest, *marks)

    # each token is looked up once
    return _with(F.array(*[F.array_contains(base, t) for t in names]), lambda there: drawn(base, there)) if names else base


def canonical_py(base: list[str], groups: list[tuple[str, list[list[str]]]]) -> list[str]:
    gone, marks, have = set(), [], set(base)
    for marker, variants in groups:
        hits = [v for v in variants if v and set(v) <= have]
        gone |= {t for v in hits for t in v}
        marks += [marker] if hits else []
    return [t for t in base if t not in gone] + marks


def alias_groups(aliases: dict[str, list[str]]) -> list[tuple[str, list[list[str]]]]:
    return [(marker_py(c), [significant_py(v) for v in (c, *synonyms)]) for c, synonyms in aliases.items()]


def term_counts(token_list: Column, terms: list[str]) -> Column:
    """How often each term occurs, as an array; counted among the few tokens that are terms."""
    met = F.filter(token_list, lambda t: t.isin(terms))
    return _with(met, lambda m: F.array(*[F.size(m) - F.size(F.array_remove(m, t)) for t in terms]))


def covers(document: Column, wanted: list[str]) -> Column:
    """Whether a document's canonical tokens hold all of the wanted ones, of which there is one at least."""
    return reduce(and_, [F.coalesce(F.array_contains(document, t), F.lit(False)) for t in wanted]) if wanted else F.lit(False)


def money(value: Column, language: str = "pt-BR") -> Column:
    shown = F.format_number(F.round(value.cast("decimal(18,4)"), 2), 2)
    return F.concat(F.lit("R$ "), F.translate(shown, ",.", ".,") if language == "pt-BR" else shown)


def discount_percent(current: Column, original: Column) -> Column:
    ok = original > current
    return F.when(ok, F.round((original - current) / F.when(ok, original) * 100).cast("int"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")
