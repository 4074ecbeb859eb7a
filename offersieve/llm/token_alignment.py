"""Alignment of two tokenizers over documents, by distinct segments.

A text (with a space in front) is cut before white space runs, where neither vocabulary can join what stands on both
sides: `safe_starts` reads from both vocabularies which white space characters stand at the beginning of tokens only, and
A's splitting into words breaks before white space anyhow. What follows a white space character outside ASCII isn't cut.
So each segment's tokens are those of the whole text, and its alignment can be made once and used wherever it occurs.

1. Texts become blocks of about BLOCK bytes: the block's distinct segments, and each text as codes into them. Blocks
   are written, so that their numbers stand.
2. Segments meet by bucket, are tokenised and aligned once each, and the alignments go back to the blocks.
3. Blocks compose their documents: counts, groups, and how often each id pair is linked. In how many documents a pair is,
   is summed by block first, then over all; the sums come back to the blocks, and the documents are finished.

No step has a key of unbounded weight: a block has a segment or a pair once, however often it occurs in it, and what many
blocks share is dealt over tasks (salted_join) or streamed.

Defined results: a null or empty text, and one with a segment whose tokens do not spell it, has no tokens and zeros; a
null doc_id comes through; each of repeated rows counts as a document; an empty table gives no rows; a very long text is a
block of its own, of some tens of times its size in one task; columns but doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offersieve.llm.common import salted_join, write_table
from offersieve.llm.shingles import pieces

#: Bytes of text in a block, and distinct segments in a bucket.
BLOCK, BUCKET = 8 << 20, 200_000
SPACE = "\t\n\x0b\x0c\r "
#: What may count as white space elsewhere, or joins with what follows it: no cut after these (as last bytes of UTF-8).
_OTHER = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_OTHER_ENDS = tuple(c.encode() for c in _OTHER)

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and where a text may be cut. A: byte-level BPE of a JSON file; B: a
    sentencepiece model that puts a space in front."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        as_byte = _byte_level()
        a_bytes = {i: bytes(as_byte[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.starts = safe_starts([x for x in self.a_bytes if len(x) > 1], [x for i, x in enumerate(self.b_bytes) if len(x) > 1 and not self.b.is_control(i)])

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with white space. The space that B puts in front is the text's own, or goes again."""
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        own = [t[0] == " " for t in texts]
        b = self.b.encode([t[1:] if o else t for t, o in zip(texts, own, strict=True)], num_threads=1)
        alone = [self.b.piece_to_id("▁")]  # nothing gets no space in front
        return a, [alone if t == " " else x if o else x[1:] for t, x, o in zip(texts, b, own, strict=True)]


@cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in
    order, from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}


def safe_starts(a: list[bytes], b: list[bytes]) -> bytes:
    """The ASCII white space characters that no token of several bytes has after anything but white space or what is never
    cut after; and that none of B has after the space that B puts in front, but for the space itself."""
    white, out = set(SPACE.encode()), []
    for c in white:
        before_a, before_b = ({t[i - 1] for t in tokens for i in range(1, len(t)) if t[i] == c and not t[:i].endswith(_OTHER_ENDS)} for tokens in (a, b))
        if before_a | before_b <= white and (c == 32 or 32 not in before_b):
            out.append(c)
    return bytes(sorted(out))


def segments(texts: pa.Array, starts: bytes) -> tuple[pa.Array, np.ndarray]:
    """The segments of non-empty texts, one after the other, and how many each text has. A cut is before a white space
    character out of `starts` that follows neither white space nor a character of _OTHER."""
    spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    raw = np.frombuffer(spaced.buffers()[2], np.uint8)[: offsets[-1]]
    kind = np.zeros(256, np.int8)
    kind[list(SPACE.encode())] = 1
    kind[list(starts)] = 2
    at = np.flatnonzero((kind[raw[1:]] == 2) & (kind[raw[:-1]] == 0)) + 1
    last = np.zeros(256, bool)
    last[[c[-1] for c in _OTHER_ENDS]] = True
    odd = np.flatnonzero(last[raw[at - 1]])
    if len(odd):
        odd = odd[[bytes(raw[max(0, i - 3) : i]).endswith(_OTHER_ENDS) for i in at[odd].tolist()]]
        at = np.delete(at, odd)
    cut = np.union1d(at, offsets[:-1])
    counts = np.diff(np.searchsorted(cut, offsets))
    bounds = np.append(cut, offsets[-1])
    return pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(bounds.tobytes()), spaced.buffers()[2]), counts


def pack(**columns) -> bytes:
    """Columns of one length as bytes."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def align(tok: Tokenizers, texts: list[str]) -> dict[str, pa.Array]:
    """For each segment: its groups as text, how many tokens, groups and links it has, whether its tokens spell it, and
    its links as a_id * 2^32 + b_id."""
    n = len(texts)
    a_ids, b_ids = tok.encode(texts)
    good = [True] * n
    for i, (t, x, y) in enumerate(zip(texts, a_ids, b_ids, strict=True)):
        raw = t.encode()
        if b"".join([tok.a_bytes[k] for k in x]) != raw or b"".join([tok.b_bytes[k] for k in y]) != raw:
            good[i], a_ids[i], b_ids[i] = False, [], []
    na, nb = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = (np.array([k for x in ids for k in x], np.int64) for ids in (a_ids, b_ids))
    # Offsets over all good segments one after the other: segments end at common cuts.
    a_end, b_end = np.cumsum(tok.a_sizes[a]), np.cumsum(tok.b_sizes[b])
    a_start, b_start = a_end - tok.a_sizes[a], b_end - tok.b_sizes[b]
    cuts = np.intersect1d(a_end, b_end)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    owner = np.repeat(np.arange(n), na)
    first = np.searchsorted(b_end, a_start, "right")
    most = np.searchsorted(b_start, a_end, "left") - first
    index = np.repeat(first - np.cumsum(most) + most, most) + np.arange(int(most.sum()))
    links = (np.repeat(a, most) << 32) | b[index]
    n_links = np.bincount(np.repeat(owner, most), minlength=n)
    group_owner = owner[np.searchsorted(a_group, np.arange(len(cuts)))]
    n_groups = np.bincount(group_owner, minlength=n)
    a_cut, b_cut = (np.searchsorted(g, np.arange(len(cuts) + 1)).tolist() for g in (a_group, b_group))
    a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
    joined = [",".join(a_text[s:e]) + "|" + ",".join(b_text[u:v]) for s, e, u, v in zip(a_cut, a_cut[1:], b_cut, b_cut[1:], strict=False)]
    g = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
    told = [";".join(joined[s:e]) for s, e in zip(g, g[1:], strict=False)]
    links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]), pa.int32()), pa.array(links))
    return {"told": pa.array(told, pa.large_string()), "na": pa.array(na), "nb": pa.array(nb), "ng": pa.array(n_groups), "nl": pa.array(n_links), "good": pa.array(good), "links": links}


def _blocks(docs: DataFrame, text: str, paths: tuple[str, str]) -> DataFrame:
    """block, docs (doc_id, how many codes), codes, segs (distinct segments in order of their codes), n_segs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, number = tokenizers(*paths).starts, 0
        for batch in pieces(batches, 1, BLOCK):
            body = batch.column(1).fill_null("")
            have = pc.greater(pc.binary_length(body), 0)
            counts = np.zeros(batch.num_rows, np.int64)
            segs, counts[np.asarray(have)] = segments(body.filter(have), starts) if pc.any(have).as_py() else (pa.array([], pa.large_string()), 0)
            coded = segs.dictionary_encode()
            block = (TaskContext.get().partitionId() << 32) + number
            number += 1
            row = [[block], [pack(doc_id=batch.column(0), size=pa.array(counts))], [pack(code=coded.indices)], [pack(seg=coded.dictionary)], [len(coded.dictionary)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["block", "docs", "codes", "segs", "n_segs"])

    cols = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    return write_table(cols.mapInArrow(cut, "block long, docs binary, codes binary, segs binary, n_segs long"))


def _dictionaries(blocks: DataFrame, paths: tuple[str, str], buckets: int) -> DataFrame:
    """block, code and align() of the block's segments, packed: each distinct segment is tokenised and aligned once, in the
    task of its bucket, which streams through what the blocks send."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segs = unpack(data.as_buffer()).column(0)
                bucket = np.fromiter((crc32(s.encode()) % buckets for s in segs.to_pylist()), np.int64, len(segs))
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                for k in range(buckets):
                    if mine := bounds[k + 1] - bounds[k]:
                        code = pa.array(order[bounds[k] : bounds[k] + mine])
                        row = [pa.array([k]), pa.array([block]), pa.array([pack(code=code, seg=segs.take(code))], pa.binary())]
                        yield pa.RecordBatch.from_arrays(row, names=["bucket", "block", "part"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, at = tokenizers(*paths), None
        known: dict[str, int] = {}
        table: pa.Table | None = None
        for batch in batches:
            for bucket, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != at:
                    at, known, table = bucket, {}, None
                part = unpack(data.as_buffer())
                segs = part.column("seg").to_pylist()
                new = [s for s in segs if s not in known]
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    made = pa.table(align(tok, new))
                    table = made if table is None else pa.concat_tables([table, made])
                    table = table.combine_chunks() if table.column(0).num_chunks > 16 else table
                mine = table.take(pa.array([known[s] for s in segs])).combine_chunks()
                row = [pa.array([block]), pa.array([pack(code=part.column("code"), **{c: mine.column(c).chunk(0) for c in mine.column_names})], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["block", "part"])

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select("block", "segs").mapInArrow(deal, "bucket long, block long, part binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(solve, "block long, part binary")


def _by_block(tables: DataFrame, finish: Callable[[int, list], pa.RecordBatch], schema: str) -> DataFrame:
    """finish(block, its parts in order of kind) for each block of tables (block, kind, part): a task holds one block."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for block, kind, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != at:
                    if held:
                        yield finish(at, held)
                    at, held = block, []
                held.append((kind, part.as_py()))
        if held:
            yield finish(at, held)

    parts = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tables.select("block", "kind", "part").repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(fold, schema)


def _compose(block: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """The block's documents without what depends on other blocks; its pairs, in how many documents each is, and how often
    each document links them."""
    docs, codes = unpack(held[0][1]), np.asarray(unpack(held[1][1]).column(0)).astype(np.int64)
    size = np.asarray(docs.column("size"))
    table = pa.Table.from_batches([unpack(p) for _, p in held[2:]]) if len(held) > 2 else pa.table(align_nothing())
    table = table.take(pc.sort_indices(table["code"])).combine_chunks()  # row i has code i
    col = {c: np.asarray(table[c]) for c in ("na", "nb", "ng", "nl", "good")}
    told, per = table["told"].to_pylist(), np.diff(np.asarray(table["links"].combine_chunks().offsets)) if len(table) else np.zeros(0, np.int64)
    flat = np.asarray(table["links"].combine_chunks().flatten()) if len(table) else np.zeros(0, np.int64)
    pairs, index = np.unique(flat, return_inverse=True)
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    bad = np.unique(owner[~col["good"][codes]])
    size_ok = size.copy()
    size_ok[bad] = 0
    keep = ~np.isin(owner, bad)
    codes, owner = codes[keep], owner[keep]
    sums = [np.bincount(owner, col[c][codes], minlength=n).astype(np.int64) for c in ("na", "nb", "ng", "nl")]
    bounds = np.concatenate([[0], np.cumsum(size_ok)]).tolist()
    as_list, sha = codes.tolist(), []
    for s, e in zip(bounds, bounds[1:], strict=False):
        sha.append(hashlib.sha256(";".join([told[c] for c in as_list[s:e]]).encode()).hexdigest() if e > s else "")
    # Distinct (document, segment) with their numbers first, then (document, pair).
    key, times = np.unique(owner * max(1, len(told)) + codes, return_counts=True)
    doc, code = np.divmod(key, max(1, len(told)))
    most = per[code]
    begin = np.cumsum(per) - per
    place = np.repeat(begin[code] - np.cumsum(most) + most, most) + np.arange(int(most.sum()))
    linked, where = np.unique(np.repeat(doc, most) * max(1, len(pairs)) + index[place], return_inverse=True)
    often = np.bincount(where, np.repeat(times, most), minlength=len(linked)).astype(np.int64)
    doc, pair = np.divmod(linked, max(1, len(pairs)))
    in_docs = np.bincount(pair, minlength=len(pairs))
    rows = pack(doc_id=docs.column("doc_id"), n_a=sums[0], n_b=sums[1], n_groups=sums[2], n_links=sums[3], groups_sha256=pa.array(sha, pa.string()))
    occ = pack(doc=doc.astype(np.int32), pair=pair.astype(np.int32), times=often)
    cols = [pa.array([block]), pa.array([rows], pa.binary()), pa.array([occ], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([in_docs], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=["block", "rows", "occ", "pairs", "in_docs"])


def align_nothing() -> dict[str, pa.Array]:
    ints = pa.array([], pa.int64())
    return {"code": ints, "told": pa.array([], pa.large_string()), "na": ints, "nb": ints, "ng": ints, "nl": ints, "good": pa.array([], pa.bool_()), "links": pa.array([], pa.list_(pa.int64()))}


def pair_counts(composed: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), blocks (that have it), best (n is the highest of its A id)."""
    of = composed.select(F.explode(F.arrays_zip("pairs", "in_docs")).alias("p"))
    counts = of.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.in_docs").alias("n"), F.count("*").alias("blocks"))
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return counts.withColumn("a", a).join(top, "a").select("pair", "n", "blocks", (F.col("n") == F.col("top")).alias("best"))


def _finish(block: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    rows, occ = unpack(held[0][1]), unpack(held[1][1])
    sums = [unpack(p) for _, p in held[2:]]
    n = np.zeros(int(np.max(np.asarray(occ.column("pair")), initial=-1)) + 1, np.int64)
    best = np.zeros(len(n), bool)
    for part in sums:
        at = np.asarray(part.column("at"))
        n[at], best[at] = np.asarray(part.column("n")), np.asarray(part.column("best"))
    doc, pair, times = (np.asarray(occ.column(c)).astype(np.int64) for c in ("doc", "pair", "times"))
    total, top = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
    np.add.at(total, doc, times * n[pair])
    np.add.at(top, doc, times * best[pair])
    cols = [*rows.columns[:5], pa.array(top), pa.array(total), rows.column(5)]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = [pack(at=x.field("at"), n=x.field("n"), best=x.field("best")) for x in (batch.column(1).slice(i, 1).flatten() for i in range(batch.num_rows))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.binary())], names=["block", "part"])


def tables(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The composed blocks, and pair_counts() of all documents; both written to the shared folder."""
    import public_tokenizers

    paths = (a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))
    blocks = _blocks(docs, text, paths)
    entries = blocks.agg(F.coalesce(F.sum("n_segs"), F.lit(0))).first()[0]
    found = _dictionaries(blocks, paths, max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET)))
    kinds = blocks.select("block", F.lit(0).alias("kind"), F.col("docs").alias("part")).union(blocks.select("block", F.lit(1), "codes")).union(found.select("block", F.lit(2), "part"))
    composed = write_table(_by_block(kinds, _compose, "block long, rows binary, occ binary, pairs array<long>, in_docs array<long>"))
    return composed, write_table(pair_counts(composed))


def alignments(docs: DataFrame, **how) -> DataFrame:
    """A row a document, of SCHEMA."""
    composed, counts = tables(docs, **how)
    of = composed.select("block", F.posexplode("pairs").alias("at", "pair"))
    entries = counts.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    met = salted_join(of, counts.select("pair", "n", "best"), counts, ["pair"], "blocks", entries, ["block"])
    back = met.groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("sums"))
    back = back.mapInArrow(_packed, "block long, part binary")
    kinds = composed.select("block", F.lit(0).alias("kind"), F.col("rows").alias("part")).union(composed.select("block", F.lit(1), "occ")).union(back.select("block", F.lit(2), "part"))
    return _by_block(kinds, _finish, SCHEMA)
