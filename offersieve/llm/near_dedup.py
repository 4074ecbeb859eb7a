"""MinHash near-dedup with sequential Bayesian verification.

Texts with equal shingle sets are one class, and only classes are compared. Signatures of classes are cut into bands;
classes that share a band are candidates. The signatures of a candidate pair are compared batch by batch; the pair is
given up as soon as the posterior probability of a similarity of at least the threshold is below the miss probability.
Survivors are verified on their full shingle sets.

A bucket of up to SMALL classes gives all its pairs. A larger one first gives a star around its smallest class by a
hash that differs from band to band. Once components of the verified links are known, its classes outside its largest
component are compared with all of its classes in other components, block by block, so no link between components is
lost, and no pair within a component is ever listed.

Defined results: a null or empty text has no shingles and is linked with nothing; a text of fewer than five words is
its whole sequence as one shingle; repeated rows are linked with each other; rows with a null doc_id take part, and a
component of such rows only has a null component_id; kept is doc_id <=> component_id; an empty table gives no rows;
columns other than doc_id and the text play no part, whatever their names; a very long text is one row's work, in a few
dozen bytes a byte. Shingles are told apart by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offersieve.llm.common import hold, materialize, release, row_hash, rows_of, same_row
from offersieve.llm.components import components
from offersieve.llm.shingles import mix64, pieces, shingle_sets

ROWS, BANDS = 5, 28
HASHES = ROWS * BANDS
SMALL = 48
#: Most classes and bytes of full sets in one side of a comparison of blocks; rows in a file of full sets.
BLOCK, BLOCK_BYTES, SET_ROWS = 2048, 16 << 20, 1 << 14
_rng = np.random.Generator(np.random.PCG64(3))
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima of seeded permutations of a set of 64-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 4096):
            m = (x[at : at + 4096][None, :] ^ _XOR[:, None]) * _ODD[:, None]
            m = (m ^ (m >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            np.minimum(out, m.min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix64(key ^ sig[k::ROWS].astype(np.uint64)) * np.uint64(0x2545F4914F6CDD1D)
    return key.view(np.int64)


@cache
def stop_below(threshold: float, miss: float, batch: int = BANDS) -> tuple[tuple[int, int], ...]:
    """(n, fewest agreements among the first n hashes to go on). With a uniform prior the posterior after m of n is
    Beta(m + 1, n - m + 1), whose tail above t is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(batch, HASHES + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def survive(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two signature matrices pass every batch."""
    alive = np.arange(len(a))
    agreed = np.zeros(len(alive), np.int64)
    before = 0
    for n, least in stop_below(threshold, miss):
        agreed = agreed + (a[alive, before:n] == b[alive, before:n]).sum(1)
        go = agreed >= least
        alive, agreed, before = alive[go], agreed[go], n
    return alive


def _signed_rows(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, row, n_shingles, cid (null without shingles), bands, sig."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            flat, offsets = shingle_sets(batch.column(2))
            n = np.diff(offsets)
            cid, bands, sigs = [], [], []
            for i in range(batch.num_rows):
                mine = flat[offsets[i] : offsets[i + 1]]
                if not len(mine):
                    cid.append(None)
                    bands.append(None)
                    sigs.append(None)
                    continue
                s = signature(mine)
                cid.append(set_id(mine))
                bands.append(band_keys(s))
                sigs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "row", "n_shingles", "cid", "bands", "sig"])

    cols = docs.select(F.col("doc_id").cast("long"), row_hash("doc_id", text).alias("row"), F.col(text).alias("text"))
    return cols.mapInArrow(sign, "doc_id long, row long, n_shingles long, cid binary, bands array<long>, sig binary")


def set_id(mine: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return mix64(np.array([np.sum(mix64(mine ^ np.uint64(x))) + np.uint64(len(mine)) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], np.uint64)).tobytes()


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _pruned(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs that the sequential test lets through."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.take(pa.array(survive(_sigs(batch.column(2)), _sigs(batch.column(3)), threshold, miss))).select(["a", "b"])

    sig = classes.select("cid", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(prune, "a binary, b binary")


def _sets(cids: DataFrame, classes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """cid, hashes: the full sets of some classes, from one text of each, read again."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            flat, offsets = shingle_sets(batch.column(1))
            sets = [flat[offsets[i] : offsets[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cid", "hashes"])

    rows = classes.select("cid", "row", F.col("lead.doc_id").alias("id")).join(cids.distinct(), "cid")
    texts = docs.select("doc_id", row_hash("doc_id", text).alias("h"), F.col(text).alias("text"))
    texts = texts.join(rows, same_row(texts, rows, "h", "row", right_id="id")).select("cid", "text")
    return materialize(texts.mapInArrow(to_sets, "cid binary, hashes binary").groupBy("cid").agg(F.first("hashes").alias("hashes")), SET_ROWS)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, per_hundred: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= per_hundred * union."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), per_hundred) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    sets = _sets(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")), classes, docs, text)
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
    out = materialize(both.mapInArrow(verify, "a binary, b binary"))
    release(sets)
    return out


def similar(x: np.ndarray, y: np.ndarray, per_hundred: int) -> bool:
    common = linked(x, y)
    return 100 * common >= per_hundred * (len(x) + len(y) - common)


def linked(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


class Union:
    """Labels that links have joined, within one task."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: bytes, y: bytes) -> None:
        self.up[self.find(x)] = self.find(y)


def _between_components(large: DataFrame, label: DataFrame, classes: DataFrame, docs: DataFrame, text: str, per_hundred: int, miss: float) -> DataFrame:
    """Links between classes of one large bucket that are in different components. Blocks of classes outside a bucket's
    largest component meet blocks of all its classes, with their signatures and full sets, so pairs are compared and
    verified where they meet, in their first shared band only. A task gives no link between labels that its links have
    joined already: fewer links than labels, however many pairs it compares."""
    member = large.select("key", "cid", "n_shingles").join(label.toDF("cid", "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    member = materialize(member)
    kinds = member.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    most = kinds.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("total"), (8 * F.sum("s")).alias("bytes"), F.count("*").alias("labels")).filter("labels > 1")
    member = materialize(member.join(most, "key"))
    sets = _sets(member.select("cid"), classes, docs, text)
    member = member.join(classes.select("cid", "sig", "bands"), "cid").join(sets, "cid")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    block = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    everyone = member.withColumn("right", block).withColumn("left", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(1))
    outside = member.filter("label <> main").withColumn("left", block).withColumn("right", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(0))
    cols = ["key", "left", "right", "side", "cid", "label", "sig", "bands", "hashes"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[bytes, bytes]] = []
        here, there = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if len(here) and len(there):
            sig = np.frombuffer(b"".join(there.sig), np.uint32).reshape(-1, HASHES)
            bands, cid, label = np.stack(list(there.bands)), there.cid.to_numpy(), there.label.to_numpy()
            full = [np.frombuffer(x, np.uint64) for x in there.hashes]
            number = int(np.flatnonzero(bands[0] == pdf.key.iloc[0])[0])
            union = Union()
            for c, lab, s, b, x in zip(here.cid, here.label, here.sig, here.bands, here.hashes, strict=True):
                todo = np.flatnonzero(label != lab)
                todo = todo[~(bands[todo, :number] == b[:number]).any(1)]
                if not len(todo):
                    continue
                s, x = np.frombuffer(s, np.uint32)[None, :], np.frombuffer(x, np.uint64)
                todo = todo[survive(np.repeat(s, len(todo), 0), sig[todo], per_hundred / 100, miss)]
                # the likeliest first
                for j in todo[np.argsort(-(sig[todo] == s).sum(1), kind="stable")].tolist():
                    if union.find(label[j]) != union.find(lab) and similar(x, full[j], per_hundred):
                        union.join(label[j], lab)
                        out.append((c, cid[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    links = materialize(outside.select(cols).union(everyone.select(cols)).groupBy("key", "left", "right").applyInPandas(compare, "a binary, b binary"))
    release(sets)
    return links


def near_duplicates(docs: DataFrame, text: str = "text", per_hundred: int = 85, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row, lead_row (the row hash of the component's one survivor), which
    goes with component_id."""
    threshold = per_hundred / 100
    signed = hold(_signed_rows(docs, text))
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    one = F.first(F.struct("bands", "sig", "n_shingles"))
    classes = hold(signed.filter("cid IS NOT NULL").groupBy("cid").agg(F.min(lead).alias("lead"), one.alias("one")).select("cid", "lead", F.col("lead.row").alias("row"), "one.bands", "one.sig", "one.n_shingles"))
    bands = classes.select("cid", "n_shingles", F.explode("bands").alias("key"))
    full = bands.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("cid", "key").alias("h"), "cid")).alias("p")).filter("n > 1")
    buckets = materialize(bands.join(full.select("key", "n", F.col("p.cid").alias("pivot")), "key"))
    small, large = buckets.filter(F.col("n") <= SMALL), buckets.filter(F.col("n") > SMALL)
    pairs = small.select("key", F.col("cid").alias("a")).join(small.select("key", F.col("cid").alias("b")), "key").filter("a < b").select("a", "b")
    star = large.filter("cid <> pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b"))
    survivors = materialize(_pruned(pairs.union(star).distinct(), classes, threshold, miss))
    links = _verified(survivors, classes, docs, text, per_hundred)
    release(survivors)
    label = components(links)
    if not large.isEmpty():
        more = _between_components(large, label, classes, docs, text, per_hundred, miss)
        if rows_of(more):
            release(label)
            label = components(links.union(more))
    release(buckets)
    known = classes.select("cid", "lead").join(label.toDF("cid", "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    heads = known.groupBy("label").agg(F.min("lead").alias("head"))
    heads = known.select("cid", "label").join(heads, "label").select("cid", "head")
    out = signed.select("doc_id", "n_shingles", "cid", "row").join(heads, "cid", "left")
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row", F.coalesce("head.row", "row").alias("lead_row"))
