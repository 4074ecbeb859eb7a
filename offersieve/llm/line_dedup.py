"""Substring dedup by hashed units: lines or paragraphs, and the sentences in them. Units are normalised, digests grouped
over the whole corpus, the earliest ranked occurrence stays and the others go, with their offsets in the original text.

Every line (or paragraph) with a word is hashed; one that occurred before goes, whatever its length. Sentences are hashed
too, as a passage is often pasted into the middle of a line: consecutive sentences that all occurred before are a passage
if they have at least `passage_words` words together, and those that are not in a removed line go as well. A shorter run
stays, as short sentences meet by chance.

Normal form: A-Z lower-cased, words (runs of anything but ASCII white space) joined by one space. Sentences end in . ! ?
or their full-width forms, and a line's sentences tile it. Ranks order occurrences, then the row's hash, then the place
in the text.

Defined results: a null or empty text has no units and loses nothing, nor does a unit without words; of repeated rows,
which share rank and hash, the first occurrence within the text counts for each of them; a null rank comes after all
others; an empty table gives no rows; other columns are kept, whatever their names, but l_spans, l_passages,
l_passage_words and l_kept are set; a very long text is one row's work, in memory of a few times its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offersieve.llm.common import materialize, row_hash, same_row

UNIT_SCHEMA = "row long, rank long, at int, d1 long, d2 long"
SEPARATORS = {"line": r"\n", "paragraph": r"\n[ \t\r]*\n"}
SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+")
PASSAGE_WORDS = 25
#: A digest with more than this share of all repeated occurrences meets them by broadcast; so there are fewer than 1 / HOT.
HOT = 1e-4


def units(text: str, sep: re.Pattern) -> Iterator[tuple[int, int, list[bytes]]]:
    """start, end and the normal words of each line with a word, each followed by its sentences (if it has more than one),
    which have their start's complement for a start. Bytes lower only A-Z and split only at ASCII white space."""
    low = text.encode().lower().decode()
    begin = 0
    for found in sep.finditer(low):
        line = low[begin : found.start()]
        if words := line.encode().split():
            yield begin, found.start(), words
            parts = [(m.start(), m.end(), w) for m in SENTENCE.finditer(line) if (w := m[0].encode().split())]
            if len(parts) > 1:
                for s, e, w in parts:
                    yield ~(begin + s), begin + e, w
        begin = found.end()


def separator(kind: str) -> re.Pattern:
    return re.compile(f"(?:{SEPARATORS[kind]})|\\Z")


def digests(docs: DataFrame, text: str = "text", rank: str = "doc_id", kind: str = "line") -> DataFrame:
    """A row for each unit: its number in the text and the 128-bit digest of its normal form. A line that is one sentence
    is hashed once; sentences of lines and lines share one space of digests, so that either can be the earlier one."""
    sep = separator(kind)
    names = [x.split()[0] for x in UNIT_SCHEMA.split(", ")]

    def table(batch: pa.RecordBatch, texts: list[int], sizes: list[int], found: list[bytes]) -> pa.RecordBatch:
        take, n = pa.array(np.repeat(texts, sizes).astype(np.int64)), np.array(sizes, np.int64)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])], names=names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts, sizes, found = [], [], []
            for i, body in enumerate(batch.column(2)):
                before = len(found)
                found += [digest(b" ".join(words)) for _, _, words in units(body.as_py() or "", sep)]
                texts.append(i)
                sizes.append(len(found) - before)
                if len(found) >= 50_000:
                    yield table(batch, texts, sizes, found)
                    texts, sizes, found = [], [], []
            yield table(batch, texts, sizes, found)

    return docs.select(row_hash(rank, text).alias("row"), F.col(rank).cast("long").alias("rank"), F.col(text).alias("text")).mapInArrow(split, UNIT_SCHEMA)


def repeated(spread: DataFrame) -> DataFrame:
    """A row a document that has any: rank, row, and the numbers of its units that occurred before, sorted.

    A digest's occurrences are summed before the shuffle. The few digests that make up a large share of all repeats come
    back to their units by a broadcast of fewer than 1 / HOT rows, and their units are spread over the join's tasks; the
    others come back by the join.
    """
    order = F.struct(F.col("rank").isNull().alias("no_rank"), "rank", "row", "at")
    first = materialize(spread.groupBy("d1", "d2").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = first.filter(F.col("n") > HOT * total).select("d1", "d2", F.col("first").alias("hot"))
    cold = first.filter(F.col("n") <= HOT * total).select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "first")
    met = spread.join(F.broadcast(hot), ["d1", "d2"], "left")
    key = F.when(F.col("hot").isNull(), F.col("d1")).otherwise(F.xxhash64("row", "at"))
    met = met.withColumn("e1", key).withColumn("e2", F.when(F.col("hot").isNull(), F.col("d2")).otherwise(F.col("row"))).join(cold, ["e1", "e2"], "left")
    later = met.withColumn("first", F.coalesce("hot", "first")).filter(order != F.col("first"))
    return later.groupBy("rank", "row").agg(F.sort_array(F.collect_set("at")).alias("again"))


def judge(text: str, again: list[int], sep: re.Pattern, least: int) -> tuple[list[tuple[int, int]], int, int]:
    """What goes, as offsets; how many passages, and how many words they have."""
    before, spans, runs, words, run, inside = set(again), [], 0, 0, [], -1

    def close() -> None:
        nonlocal runs, words
        size = sum(n for _, _, n, _ in run)
        if size >= least:
            runs, words = runs + 1, words + size
            spans.extend((s, e) for s, e, _, free in run if free)
        run.clear()

    found = list(enumerate(units(text, sep)))
    for k, (i, (s, e, w)) in enumerate(found):
        if s >= 0:
            inside = i if i in before else -1
            if inside >= 0:
                spans.append((s, e))
            if k + 1 < len(found) and found[k + 1][1][0] < 0:
                continue  # its sentences follow
        if i in before:
            run.append((~s if s < 0 else s, e, len(w), s < 0 and inside < 0))
        else:
            close()
    close()
    return sorted(set(spans)), runs, words


def dedup_lines(docs: DataFrame, text: str = "text", rank: str = "doc_id", kind: str = "line", passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """docs with l_spans (what goes), l_passages and l_passage_words (runs of sentences, removed lines included), and
    l_kept (the rest of the text; a removed line takes the line end after it along)."""
    sep = separator(kind)
    gone = repeated(digests(docs, text, rank, kind)).withColumnRenamed("rank", "l_rank").withColumnRenamed("row", "l_row")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(rank).cast("long").alias("rank"), F.col(text).alias("text"), row_hash(rank, text).alias("h"))
    out = whole.join(gone, same_row(whole, gone, "h", "l_row", "rank", "l_rank"), "left")
    schema = "l_spans array<struct<start:int,end:int>>, l_passages long, l_passage_words long, l_kept string"

    def cut(texts: pd.Series, again: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a in zip(texts, again, strict=True):
            spans, runs, words = judge(t, list(a), sep, passage_words) if a is not None else ([], 0, 0)
            rows.append(([{"start": s, "end": e} for s, e in spans], runs, words, _without(t, spans) if spans else None))
        return pd.DataFrame(rows, columns=["l_spans", "l_passages", "l_passage_words", "l_kept"])

    judged = F.pandas_udf(cut, schema)("text", "again")
    out = out.withColumn("l", judged)
    mine = ("l_spans", "l_passages", "l_passage_words", "l_kept")
    return out.select(*(F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in mine), *(F.col(f"l.{c}") for c in mine[:3]), F.coalesce("l.l_kept", "text").alias("l_kept"))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
        if text[max(0, s - 1) : s] in ("", "\n") and re.match(r"\r?\n", text[e : e + 2]):
            at += 1 + (text[e] == "\r")
    return "".join([*out, text[at:]])
