"""The ordered signature table of the license scan. Plain data: names, keywords, phrase templates.

Each rule is (label, keyword, regex, priority): a document is tried against a rule only if it holds each word of the
keyword, wherever they are; both see the text with A-Z in lower case. Priority 3: an identifier tag; 2: a full name in a licensing phrase; 1: a notice.
"""

from __future__ import annotations

#: Between the words of a phrase: anything but a letter, digit or non-ASCII character.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BEFORE, AFTER = r"(?<![0-9a-z\x{80}-\x{10FFFF}])", r"(?![0-9a-z\x{80}-\x{10FFFF}])"

# Fixed values: (label, identifier as in a tag, keyword, name as a pattern; a space stands for any gap).
LICENSES = [
    ("apache-1.1", r"apache-1\.1", "apache", r"apache (?:software )?licen[sc]e,? (?:version )?1\.1"),
    ("apache-2.0", r"apache-2\.0", "apache", r"apache (?:software )?licen[sc]e,? (?:version |v)?2(?:\.0)?"),
    ("mit", r"mit", "mit", r"mit licen[sc]e"),
    ("mit-0", r"mit-0", "mit", r"mit no attribution"),
    ("x11", r"x11", "x11", r"x11 licen[sc]e"),
    ("bsd-2-clause", r"bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd) licen[sc]e"),
    ("bsd-3-clause", r"bsd-3-clause", "bsd", r"(?:modified bsd|new bsd|bsd 3 clause|3 clause bsd) licen[sc]e"),
    ("bsd-4-clause", r"bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e"),
    ("0bsd", r"0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause) licen[sc]e"),
    ("isc", r"isc", "isc", r"isc licen[sc]e"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later)?", "general", r"gnu general public licen[sc]e,? version 1"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later)?", "general", r"(?:gnu )?general public licen[sc]e,? (?:version |v)2"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later)?", "general", r"(?:gnu )?general public licen[sc]e,? (?:version |v)3"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later)?", "lesser", r"gnu lesser general public licen[sc]e,? (?:version |v)2"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later)?", "lesser", r"gnu lesser general public licen[sc]e,? (?:version |v)3"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later)?", "affero", r"gnu affero general public licen[sc]e"),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", "documentation", r"gnu free documentation licen[sc]e"),
    ("mpl-1.1", r"mpl-1\.1", "mozilla", r"mozilla public licen[sc]e,? (?:version )?1\.1"),
    ("mpl-2.0", r"mpl-2\.0", "mozilla", r"mozilla public licen[sc]e,? (?:version |v )?2"),
    ("epl-1.0", r"epl-1\.0", "eclipse", r"eclipse public licen[sc]e,? (?:version |v )?1"),
    ("epl-2.0", r"epl-2\.0", "eclipse", r"eclipse public licen[sc]e,? (?:version |v )?2"),
    ("cddl-1.0", r"cddl-1\.0", "common development", r"common development and distribution licen[sc]e"),
    ("cpl-1.0", r"cpl-1\.0", "common public", r"common public licen[sc]e"),
    ("eupl-1.2", r"eupl-1\.2", "european union", r"european union public licen[sc]e"),
    ("artistic-1.0", r"artistic-1\.0", "artistic", r"artistic licen[sc]e,? (?:version )?1"),
    ("artistic-2.0", r"artistic-2\.0", "artistic", r"artistic licen[sc]e,? (?:version )?2"),
    ("zlib", r"zlib", "zlib", r"zlib licen[sc]e"),
    ("libpng", r"libpng(?:-2\.0)?", "libpng", r"libpng licen[sc]e"),
    ("bsl-1.0", r"bsl-1\.0", "boost", r"boost software licen[sc]e"),
    ("busl-1.1", r"busl-1\.1", "business source", r"business source licen[sc]e"),
    ("unlicense", r"unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", r"wtfpl", "public licen", r"do what the [^ ]{4} you want to public licen[sc]e"),
    ("cc0-1.0", r"cc0-1\.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?"),
    ("cc-by-1.0", r"cc-by-1\.0", "attribution", r"creative commons attribution 1\.0"),
    ("cc-by-2.0", r"cc-by-2\.0", "attribution", r"creative commons attribution 2\.0"),
    ("cc-by-2.5", r"cc-by-2\.5", "attribution", r"creative commons attribution 2\.5"),
    ("cc-by-3.0", r"cc-by-3\.0", "attribution", r"creative commons attribution 3\.0"),
    ("cc-by-4.0", r"cc-by-4\.0", "attribution", r"creative commons attribution 4\.0"),
    ("cc-by-sa-3.0", r"cc-by-sa-3\.0", "sharealike", r"creative commons attribution sharealike 3\.0"),
    ("cc-by-sa-4.0", r"cc-by-sa-4\.0", "sharealike", r"creative commons attribution sharealike 4\.0"),
    ("cc-by-nc-3.0", r"cc-by-nc-3\.0", "noncommercial", r"creative commons attribution noncommercial 3\.0"),
    ("cc-by-nc-4.0", r"cc-by-nc-4\.0", "noncommercial", r"creative commons attribution noncommercial 4\.0"),
    ("cc-by-nd-4.0", r"cc-by-nd-4\.0", "noderiv", r"creative commons attribution noderiv[a-z]* 4\.0"),
    ("cc-by-nc-sa-4.0", r"cc-by-nc-sa-4\.0", "noncommercial", r"creative commons attribution noncommercial sharealike 4\.0"),
    ("cc-by-nc-nd-4.0", r"cc-by-nc-nd-4\.0", "noncommercial", r"creative commons attribution noncommercial noderiv[a-z]* 4\.0"),
    ("odbl-1.0", r"odbl-1\.0", "open database", r"open database licen[sc]e"),
    ("odc-by-1.0", r"odc-by-1\.0", "open data", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", r"pddl-1\.0", "public domain", r"public domain dedication and licen[sc]e"),
    ("ofl-1.1", r"ofl-1\.1", "open font", r"sil open font licen[sc]e"),
    ("psf-2.0", r"psf-2\.0", "python", r"python software foundation licen[sc]e"),
    ("php-3.01", r"php-3\.01", "php", r"php licen[sc]e"),
    ("ruby", r"ruby", "ruby", r"ruby licen[sc]e"),
    ("perl", r"perl", "perl", r"same terms as perl"),
    ("openssl", r"openssl", "openssl", r"openssl licen[sc]e"),
    ("postgresql", r"postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("ncsa", r"ncsa", "illinois", r"university of illinois/ncsa open source licen[sc]e"),
    ("ms-pl", r"ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", r"ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("upl-1.0", r"upl-1\.0", "universal permissive", r"universal permissive licen[sc]e"),
    ("osl-3.0", r"osl-3\.0", "open software", r"open software licen[sc]e"),
    ("afl-3.0", r"afl-3\.0", "academic free", r"academic free licen[sc]e"),
    ("sspl-1.0", r"sspl-1\.0", "server side", r"server side public licen[sc]e"),
    ("elastic-2.0", r"elastic-2\.0", "elastic", r"elastic licen[sc]e"),
    ("vim", r"vim", "vim", r"vim licen[sc]e"),
    ("w3c", r"w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e"),
    ("json", r"json", "json", r"json licen[sc]e"),
    ("beerware", r"beerware", "beer", r"beer ware licen[sc]e"),
    ("unicode-dfs-2016", r"unicode-dfs-2016", "unicode", r"unicode licen[sc]e agreement"),
    ("openrail", r"openrail(?:\+\+)?(?:-m)?", "openrail", r"(?:creativeml )?openrail(?: m)? licen[sc]e"),
    ("gpl-any", r"gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("lgpl-any", r"lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("apache-any", r"apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("bsd-any", r"bsd", "bsd", r"bsd (?:style )?licen[sc]e"),
    ("cc-any", r"cc", "creative commons", r"creative commons(?: licen[sc]e)?"),
]

# Notices, (label, keyword, pattern).
NOTICES = [
    ("copyright", "copyright", r"copyright (?:\(c\) |© )?(?:19|20)[0-9]{2}"),
    ("copyright", "copyright", r"copyrighted (?:material|work)"),
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "permission", r"without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain"),
    ("permissive", "permission", r"permission is hereby granted,? free of charge"),
    ("permissive", "redistribution", r"redistribution and use in source and binary forms"),
    ("no-warranty", "warrant", r"without (?:any )?warrant(?:y|ies)"),
    ("no-warranty", "provided", r"provided (?:\W)?as is"),
    ("license-notice", "licensed", r"licensed under the"),
    ("license-notice", "licen", r"see (?:the )?(?:file )?licen[sc]e"),
    ("non-commercial", "commercial", r"(?:non ?commercial|not for commercial) use"),
    ("no-redistribution", "redistribut", r"(?:do not|may not be|not be) redistributed?"),
    ("terms", "terms of", r"terms of (?:use|service)"),
]

# Templates by which each license makes three rules: a tag, a licensing phrase, the bare name.
TAG = r"spdx[\- ]license[\- ]identifier: ?(?:\()?{id}(?![\-.0-9a-z])"
PHRASE = r"(?:licen[sc]ed|released|distributed|available|published|redistributed) (?:[a-z]+ )?(?:under|by) (?:the )?(?:terms of )?(?:the )?{name}"


def _gaps(pattern: str) -> str:
    return BEFORE + pattern.replace(" ", GAP) + AFTER


def rules() -> list[tuple[str, str, str, int]]:
    """All rules, in the order of the table."""
    out = []
    for label, ident, keyword, name in LICENSES:
        out.append((label, "spdx", BEFORE + TAG.replace("{id}", ident), 3))
        out.append((label, keyword, _gaps(PHRASE.replace("{name}", f"(?:{name})")), 2))
        out.append((label, keyword, _gaps(name), 1))
    return out + [(label, keyword, _gaps(p), 1) for label, keyword, p in NOTICES]


#: No rule can match a text that holds all words of none of these.
GATE = ["licen", "spdx", "rights reserved", "copyright", "permission", "public domain", "warrant", "redistribut", "commercial", "proprietary", "terms", "provided", "mit no", "cc0", "creative commons", "openrail"]
