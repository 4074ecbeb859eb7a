"""Suffix-array dedup: what a string of `width` symbols covers that also starts elsewhere, found exactly. Symbols are
bytes or, for passages of so many words, words (as they are written; white space between them does not count).

Every window of `width` symbols has one anchor, its least-hashed gram of width / 2; equal windows have equal anchors
at equal places. Windows in a row with one anchor make a context. Anchors that occur once, nearly all, go at once.
Contexts that occur more than once are repeats whole. Where different contexts share an anchor, one copy of each goes to
the anchor's task, which builds the suffix array of its contexts and takes, for every window, the previous and next
smaller positions in suffix order: the longest previous factor reaches `width` exactly if one of them does. The previous
and next larger positions tell the same of later places.

`repeats` removes either all copies, or, with keep_first, all but the first in order of (doc_id, row hash, position).

Defined results: a null or empty text has no symbols and loses none, as does one shorter than `width`; a null doc_id comes
after all others; repeated rows repeat each other's symbols, and, as they can't be told apart, with keep_first each keeps
what the first one keeps; an empty table gives no rows; overlapping repeats count; other columns play no part, whatever
their names; very long texts are taken in stretches that overlap by width - 1. Windows are compared symbol by symbol,
anchors and whole contexts by hashes modulo a prime at four random points, 124 bits; words by 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offersieve.llm.common import hold, materialize, release, row_hash, rows_of, salted_join, same_row
from offersieve.llm.shingles import ANCHOR, WHOLE, Rolling, byte_grams, pieces, text_bytes, word_grams, word_hashes, word_places

WIDTH = 400
#: Bytes of text whose windows are hashed at once, few enough for their arrays to stay in a core's cache.
PIECE = 1 << 17
PIECE_BITS = 18
#: Bytes of contexts in one suffix array; an anchor with more is settled by window digests instead.
CHUNK, HOT = 1 << 15, 4 << 20
#: Rows in a file of contexts with their bytes.
CONTEXT_ROWS = 1 << 16

INSTANCE = "doc_id long, row long, lo int, size int, g long, c long"


def rolling(symbols: np.ndarray, *points: tuple[int, int]) -> list[Rolling]:
    """A hash over the symbols for each pair of points."""
    grams, size = (byte_grams(symbols), 8) if symbols.dtype == np.uint8 else (word_grams(symbols), 4)
    return [Rolling(grams, size, p) for p in points]


def symbols_of(raw: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts one after the other, and the offsets of the texts in them."""
    if unit == "byte":
        return raw, offsets
    hashes, counts = [], np.zeros(len(offsets), np.int64)
    # A very long text is read in stretches that end in white space.
    for start, end in _word_cuts(raw):
        inner = np.clip(offsets, start, end) - start
        starts, ends = word_places(raw[start:end], np.unique(inner))
        hashes.append(word_hashes(raw[start:end], starts, ends))
        counts += np.searchsorted(starts, inner)
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), counts


def _word_cuts(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(raw):
        end = min(len(raw), start + PIECE)
        while end < len(raw) and raw[end] not in (9, 10, 11, 12, 13, 32):
            end += 1
        yield start, end
        start = end


def contexts_of(symbols: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other in symbols, ending at ends: start and end (exclusive) of each context, the hash of its
    anchor, and its own."""
    none = np.zeros(0, np.int64)
    n, gram = len(symbols), width // 2
    if n < width:
        return none, none, none, none
    anchors, contexts = rolling(symbols, ANCHOR, WHOLE)
    grams = anchors.all(gram)
    at = np.arange(n - gram + 1)
    low = np.uint64((1 << PIECE_BITS) - 1)  # the same for every piece, so that equal windows choose alike
    key = (grams & ~low) | at.astype(np.uint64)
    w = width - gram + 1
    full = -(-len(key) // w) * w
    blocks = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    chosen = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & low).astype(np.int64)
    sizes = np.diff(np.concatenate([[0], ends]))
    valid = np.arange(windows) + width <= np.repeat(ends, sizes)[:windows]
    chosen[~valid] = -1
    cut = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([cut[1:], [windows]]) - 1
    real = chosen[cut] >= 0
    lo, hi = cut[real], last[real] + width
    return lo, hi, grams[chosen[lo]].view(np.int64), contexts.of(lo, hi).view(np.int64)


def _instances(docs: DataFrame, text: str, width: int, unit: str) -> DataFrame:
    names = [x.split()[0] for x in INSTANCE.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, PIECE):
            symbols, offsets = symbols_of(*text_bytes(batch.column(2)), unit)
            # A very long text is cut into stretches that overlap by width - 1 symbols: every window is in one of them.
            for start in range(0, max(1, len(symbols) - width + 1), PIECE if batch.num_rows == 1 else max(1, len(symbols))):
                part = symbols[start : start + PIECE + width - 1] if batch.num_rows == 1 else symbols
                ends = np.array([len(part)]) if batch.num_rows == 1 else offsets[1:]
                lo, hi, g, c = contexts_of(part, ends, width)
                owner = np.searchsorted(ends, lo, "right")
                first = start + lo - (offsets[owner] if batch.num_rows > 1 else 0)
                take = pa.array(owner)
                cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int32()), pa.array(hi - lo, pa.int32()), pa.array(g, pa.int64()), pa.array(c, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    cols = docs.select(F.col("doc_id").cast("long"), row_hash("doc_id", text).alias("row"), F.col(text).alias("text"))
    return cols.mapInArrow(find, INSTANCE)


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return order, rank


def suffix_order(flat: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of symbols below 2^bits by their first `width` symbols, equal ones by position, and each suffix's
    rank (equal for equal prefixes). Symbols that fit one integer together are sorted at once; then prefix doubling:
    each round sorts pairs of ranks."""
    n = len(flat)
    have = min(width, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(min(have, n)):
        key[: n - k] |= flat[k:].astype(np.int64) << (bits * (have - 1 - k))
    _, rank = _dense(key)
    while have < width:
        step = min(have, width - have)
        key = rank * np.int64(n + 1)
        key[: n - step] += rank[step:] + 1
        _, rank = _dense(key)
        have += step
    return np.argsort(rank * np.int64(n) + np.arange(n)), rank


def nearest_smaller(order: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the nearest place before it that holds a smaller position; -1 if none.
    Pointers jump over what is larger, all at once."""
    at = np.arange(len(order)) - 1
    todo = np.flatnonzero(at >= 0)
    while len(todo := todo[(at[todo] >= 0) & (order[at[todo]] > order[todo])]):
        at[todo] = at[at[todo]]
    return at


def factors(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the texts one after the other: where each starts, and for every position whether the longest previous factor
    reaches `width`, and whether the longest later one does. Each text is followed by a symbol that no text has; what
    holds it is no window, and is neither told of nor compared with a window."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.int64)
    inside = np.ones(len(flat), bool)
    inside[starts + sizes - 1] = False
    held = np.concatenate(texts)
    flat[inside] = held.astype(np.int64) + 1 if held.dtype == np.uint8 else _dense(held)[1] + 1
    order, rank = suffix_order(flat, width, int(flat.max()).bit_length() or 1)
    n = len(order)
    sorted_rank = rank[order]

    def reaches(order: np.ndarray) -> np.ndarray:
        before = nearest_smaller(order)
        after = n - 1 - nearest_smaller(order[::-1])[::-1]
        same = lambda other, ok: ok & (sorted_rank[np.clip(other, 0, n - 1)] == sorted_rank)
        return same(before, before >= 0) | same(after, after < n)

    earlier, later = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order] = reaches(order)
    later[order] = reaches(n - 1 - order)
    return starts, earlier, later


def _stretches(flags: np.ndarray, width: int) -> list[int]:
    """start, end, start, end ... of the bytes that windows with a flag cover."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    out: list[int] = []
    for s, e in zip(edges[::2].tolist(), (edges[1::2] + width - 1).tolist(), strict=True):
        if out and s <= out[-1]:
            out[-1] = e
        else:
            out += [s, e]
    return out


def _by_suffix_array(contexts: DataFrame, width: int, chunk: int, unit: str, keep_first: bool) -> DataFrame:
    """g, c, spans: stretches of each context that repeat what is earlier, or, without keep_first, what is anywhere else.
    A task streams through its anchors."""
    kind = np.uint8 if unit == "byte" else np.uint64

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            texts = [np.frombuffer(t, kind) for _, _, t in held]
            starts, earlier, later = factors(texts, width)
            gone = earlier if keep_first else earlier | later
            rows = []
            for (g, c, _), t, s in zip(held, texts, starts, strict=True):
                mine = gone[s : s + len(t) - width + 1]
                if mine.any():
                    rows.append((g, c, _stretches(mine, width)))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(list(x), y) for x, y in zip(cols, types, strict=True)], names=["g", "c", "spans"])

        for batch in batches:
            for g, c, t in zip(*(x.to_pylist() for x in batch.columns[:3]), strict=True):
                if held and held[-1][:2] == (g, c):
                    continue  # the same context of a repeated row
                if size >= chunk and held[-1][0] != g:
                    yield flush()
                    held, size = [], 0
                held.append((g, c, t))
                size += len(t)
        if held:
            yield flush()

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(parts, "g").sortWithinPartitions("g", "first", "c")
    return dealt.select("g", "c", "bytes").mapInArrow(solve, "g long, c long, spans array<int>")


def _by_digests(contexts: DataFrame, width: int, unit: str, keep_first: bool) -> DataFrame:
    """The same for anchors with more contexts than a task should hold: digests of their windows, grouped over all tasks."""
    kind = np.uint8 if unit == "byte" else np.uint64

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column(2)[i].as_buffer(), kind)
                at = np.arange(len(raw) - width + 1)
                k = len(at)
                pick = pa.array(np.full(k, i))
                w, v = (r.all(width).view(np.int64) for r in rolling(raw, ANCHOR, WHOLE))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), batch.column(3).take(pick), pa.array(at, pa.int32()), pa.array(w), pa.array(v)], names=["g", "c", "first", "x", "w", "v"])

    one = contexts.dropDuplicates(["g", "c"])
    spelt = materialize(one.select("g", "c", "bytes", "first").mapInArrow(spell, f"g long, c long, first {contexts.schema['first'].dataType.simpleString()}, x int, w long, v long"))
    order = F.struct("first", "x")
    shared = spelt.groupBy("g", "w", "v").agg(F.count("*").alias("n"), F.min(order).alias("head")).filter("n > 1")
    gone = order > F.col("head") if keep_first else F.lit(True)
    marked = spelt.join(shared, ["g", "w", "v"]).filter(gone).select("g", "c", "x")
    grouped = marked.groupBy("g", "c").agg(F.collect_set("x").alias("at"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(xs: list[int]) -> list[int]:
            flags = np.zeros(max(xs) + 1, bool)
            flags[xs] = True
            return _stretches(flags, width)

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([spans(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int32()))], names=["g", "c", "spans"])

    return grouped.mapInArrow(join_up, "g long, c long, spans array<int>")


def _contexts(docs: DataFrame, wanted: DataFrame, text: str, unit: str) -> DataFrame:
    """g, c, first and symbols (as bytes) of the wanted contexts, cut from the documents that hold their first copy."""
    need = wanted.groupBy("id", "row").agg(F.collect_list(F.struct("lo", "size", "g", "c", "first")).alias("need"))
    texts = docs.select("doc_id", row_hash("doc_id", text).alias("h"), F.col(text).alias("text"))
    texts = texts.join(need, same_row(texts, need, "h", "row", right_id="id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0, PIECE):
            symbols, offsets = symbols_of(*text_bytes(batch.column(0)), unit)
            lists = batch.column(1)
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            lo = flat.field("lo").to_numpy() + offsets[owner]
            hi = lo + flat.field("size").to_numpy()
            cut_out = [symbols[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("g"), flat.field("c"), flat.field("first"), pa.array(cut_out, pa.binary())], names=["g", "c", "first", "bytes"])

    return texts.select("text", "need").mapInArrow(cut, f"g long, c long, first {wanted.schema['first'].dataType.simpleString()}, bytes binary")


def repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, keep_first: bool = False, unit: str = "byte", chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """id, row, spans: for each document (by id and row hash) that has any, the sorted stretches of symbols that go."""
    found = hold(_instances(docs, text, width, unit))
    several = materialize(found.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "lo")
    shared = materialize(salted_join(found, several, several, ["g"], "n", rows_of(found), ["doc_id", "row", "lo"]).select("row", "lo", "size", "g", "c", order.alias("at")))
    release(found)
    groups = materialize(shared.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("at", "size")).alias("head")).select("g", "c", "n", F.col("head.at").alias("first"), F.col("head.size").alias("size")))
    per = 1 if unit == "byte" else 8
    kinds = groups.groupBy("g").agg(F.count("*").alias("kinds"), F.sum(F.col("size").cast("long") * per).alias("bytes")).filter("kinds > 1")
    wanted = groups.join(kinds, "g").select("g", "c", "first", "size", F.col("first.doc_id").alias("id"), F.col("first.row").alias("row"), F.col("first.lo").alias("lo"), (F.col("bytes") > hot).alias("hot"))
    wanted = materialize(wanted)
    solved = materialize(_by_suffix_array(_contexts(docs, wanted.filter("NOT hot").drop("hot"), text, unit), width, chunk, unit, keep_first))
    if not wanted.filter("hot").isEmpty():
        solved = solved.union(_by_digests(_contexts(docs, wanted.filter("hot").drop("hot"), text, unit), width, unit, keep_first))
    whole = F.array(F.lit(0), F.col("size"))
    told = groups.join(solved, ["g", "c"], "left").filter("n > 1 OR spans IS NOT NULL").drop("size")
    hit = salted_join(shared, told, groups, ["g", "c"], "n", rows_of(shared), ["at"])
    own = F.coalesce("spans", F.array().cast("array<int>"))
    if keep_first:
        spans = F.when(F.col("at") == F.col("first"), own).otherwise(whole)
    else:
        spans = F.when(F.col("n") > 1, whole).otherwise(own)
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct((F.col("lo") + F.get("spans", i)).alias("start"), (F.col("lo") + F.get("spans", i + 1)).alias("end")))
    hit = hit.withColumn("spans", spans).filter(F.size("spans") > 0).select(F.col("at.doc_id").alias("id"), "row", F.explode(pairs).alias("s"))
    return hit.groupBy("id", "row").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def merged(spans: list[dict] | None, touch: bool = True) -> list[list[int]]:
    """Spans that overlap as one; with touch those that adjoin too."""
    out: list[list[int]] = []
    for s in spans if spans is not None else ():
        if out and s["start"] < out[-1][1] + touch:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return out


def _with_spans(docs: DataFrame, text: str, kinds: list[dict]) -> DataFrame:
    """doc (the whole row), doc_id, text and s0, s1 ...: what goes by each of the kinds, sorted."""
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), row_hash("doc_id", text).alias("h"))
    for i, how in enumerate(kinds):
        gone = repeats(docs, text, **how).withColumnRenamed("spans", f"s{i}")
        out = out.join(gone, same_row(out, gone, "h", "row", right_id="id"), "left").drop("id", "row")
    return out


def digest(docs: DataFrame, text: str = "text", passages: int = 0, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with passages also passage_words: how many words of the text are
    in a passage of at least so many words that occurs anywhere else too, whatever the bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for body, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = memoryview(body.as_buffer()) if body.is_valid else memoryview(b"")
                gone, at, sha = merged(spans), 0, hashlib.sha256()
                for s, e in gone:
                    sha.update(raw[at:s])
                    at = e
                sha.update(raw[at:])
                for c, v in zip(out, (len(raw), sum(e - s for s, e in gone), len(gone), sha.hexdigest()), strict=True):
                    c.append(v)
            cols = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            words = [pa.array([sum(e - s for s, e in merged(x)) for x in batch.column(3).to_pylist()], pa.int64())] if passages else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *words], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words"][: 5 + bool(passages)])

    kinds = [how, {"width": passages, "unit": "word"}] if passages else [how]
    out = _with_spans(docs, text, kinds).select("doc_id", "text", *(f"s{i}" for i in range(len(kinds))))
    return out.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", passage_words long" * bool(passages))


def cut_texts(docs: DataFrame, text: str = "text", unit: str = "byte", **how) -> DataFrame:
    """docs with the repeats cut out of the text. Spans of bytes shrink to whole characters, so the rest is valid UTF-8;
    of words, the white space between them goes along."""

    def cut(texts, spans):
        import pandas as pd

        return pd.Series([_without(a, b, unit) for a, b in zip(texts, spans, strict=True)])

    udf = F.pandas_udf(cut, "string")
    out = _with_spans(docs, text, [how | {"unit": unit}])
    left = F.when(F.col("s0").isNull(), F.col("text")).otherwise(udf("text", "s0"))
    return out.withColumn("left", left).select(*(F.col("left").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns))


def _without(text: str | None, spans, unit: str = "byte") -> str | None:
    if text is None or spans is None:
        return text
    raw, out, at = text.encode(), [], 0
    if unit == "word":
        flat = np.frombuffer(raw, np.uint8)
        starts, ends = word_places(flat, np.array([0, len(flat)]))
    for s, e in merged(spans):
        if unit == "word":
            s, e = int(starts[s]), int(ends[e - 1])
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]).decode()
