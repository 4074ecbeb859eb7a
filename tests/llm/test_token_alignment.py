"""Alignments by segments against whole texts encoded at once, and odd texts and tables."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offersieve.llm import token_alignment

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tok():
    return token_alignment.tokenizers(*PATHS)


def _whole(tok, text):
    """A ids, B ids of a text encoded in one piece; nothing if they don't spell it."""
    if not text:
        return [], []
    a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    raw = (" " + text).encode()
    return (a, b) if b"".join(tok.a_bytes[i] for i in a) == raw == b"".join(tok.b_bytes[i] for i in b) else ([], [])


def _ends(sizes):
    out = [0]
    for n in sizes:
        out.append(out[-1] + n)
    return out


def _plain(tok, rows):
    docs, in_docs = [], Counter()
    for doc_id, text in rows:
        a, b = _whole(tok, text)
        x, y = _ends(len(tok.a_bytes[i]) for i in a), _ends(len(tok.b_bytes[i]) for i in b)
        links, j = [], 0
        for i in range(len(a)):
            while y[j + 1] <= x[i]:
                j += 1
            k = j
            while k < len(b) and y[k] < x[i + 1]:
                links.append((a[i], b[k]))
                k += 1
        cuts = sorted(set(x) & set(y))
        of = lambda ids, ends: [",".join(str(ids[i]) for i in range(bisect_left(ends, s), bisect_left(ends, e))) for s, e in zip(cuts, cuts[1:])]  # noqa: B023, E731
        groups = ["|".join(g) for g in zip(of(a, x), of(b, y))]
        docs.append((doc_id, len(a), len(b), len(cuts) - 1, links, groups))
        in_docs.update(set(links))
    top = defaultdict(int)
    for (a, _), n in in_docs.items():
        top[a] = max(top[a], n)
    out = []
    for doc_id, na, nb, ng, links, groups in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if links else ""
        out.append((doc_id, na, nb, ng, len(links), sum(in_docs[x] == top[x[0]] for x in links), sum(in_docs[x] for x in links), sha))
    return sorted(out, key=repr)


ODD = [
    (9000, None), (9001, ""), (9002, " "), (9003, "  \n\n "), (9004, "a ▁ b"), (9005, "x;\r\ny"), (9006, "tab\there\n\tand"), (9007, "<|endoftext|> <s> </s> <0x41>"),
    (None, "no id here"), (None, None), (9008, "trailing "), (9008, "trailing "), (9009, "nb\xa0sp 　wide thin"), (9010, "漢字かな交じり文。次の文 です"), (9011, "it's  we'll 'S"), (9012, "\x1c \x00 \x85 x"), (9013, "🙂🙂 é́"),
]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block,bucket", [(token_alignment.BLOCK, token_alignment.BUCKET), (4000, 300)])
def test_against_whole_texts(spark, tok, monkeypatch, block, bucket):
    monkeypatch.setattr(token_alignment, "BLOCK", block)
    monkeypatch.setattr(token_alignment, "BUCKET", bucket)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 9000")
    docs = docs.union(spark.createDataFrame(ODD, "doc_id long, text string"))
    assert _rows(token_alignment.alignments(docs.repartition(3))) == _plain(tok, [tuple(r) for r in docs.collect()])


def test_cuts_leave_the_tokens_as_they_are(tok):
    assert tok.starts == b"\t\n\x0b\x0c "  # a carriage return follows other signs in tokens of B
    rnd = random.Random(5)
    signs = ["a", "b", "the", "'s", "1", "22", ".", ";", "\r", "\n", "\t", " ", "  ", "\x0b", "<s>", *map(chr, (0xA0, 0x2003, 0x3000, 0x1C, 0xE9, 0x6F22, 0x2581, 0x1F642, 0x301, 0x200B, 0x85))]
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 14)))
        segs, counts = token_alignment.segments(pa.array([text]), tok.starts)
        segs = segs.to_pylist()
        assert "".join(segs) == " " + text and counts.tolist() == [len(segs)]
        if "▁" in text:
            continue
        a, b = tok.encode(segs)
        assert [i for x in a for i in x] == tok.a.encode(" " + text, add_special_tokens=False).ids, text
        assert [i for x in b for i in x] == tok.b.encode(text), text


def test_odd_tables(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    want = _rows(token_alignment.alignments(docs))
    wide = docs.select("*", *(F.lit(1).alias(c) for c in ("block", "kind", "part", "pair", "n", "a", "at", "codes", "docs")))
    assert _rows(token_alignment.alignments(wide)) == want
    assert token_alignment.alignments(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000)], "doc_id long, text string")
    row = token_alignment.alignments(long).first()
    assert row.n_groups == row.n_links == row.n_best == row.count_sum == 300_001
