"""Periodic runs of words: stretches of smallest period q and at least max(24, 3 q) words that can't be extended.

Masking first. In a run of length L and period q every k-gram stands q words further on or back as well, if
k <= L - 2 q + 1; over all runs asked for the least of these bounds is at q = 24 / 3, which gives k = 9. So words outside
repeated k-grams of their document are in no run, and neither are stretches of repeated ones that are shorter than a run.
Gram hashes can only let through too much.

Main-Lorentz then halves what is left again and again: a run that crosses the middle of a part, and no middle above it,
lies in that part and holds the word before or after the middle q words away too. The common extensions of the two
places, to both sides, give the run. They are read from names of all stretches of 2^j words (equal names for equal words,
by sorting), so no hash decides anything. All parts of a level go at once, in numpy.

Defined results: a null text has no words; a null doc_id plants nothing and comes through as null; repeated rows are
judged each by itself; ties among runs go by start, then period; an empty table gives no rows; a very long text is one
task's work, of about 100 bytes for a word in the masked stretches; columns but doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offersieve.llm.shingles import mix64

#: Words of a run at least, and how many periods; the middle's test needs three periods or more.
LEAST, POWER = 24, 3
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"


def overlap(least: int = LEAST, power: int = POWER) -> int:
    """The longest k of which every k-gram of any run occurs twice in it."""
    return min(max(least, power * q) - 2 * q + 1 for q in range(1, least + 1))


def plant(words: list[bytes], h: int | None) -> list[bytes]:
    """The words with a periodic end, in the tenth of documents whose hash says so."""
    n = len(words)
    if not n or h is None or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def repeated_stretches(ids: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """Start and end, in words, of the longest stretches of which every k-gram occurs elsewhere in ids."""
    n = len(ids) - k + 1
    if n < 2:
        return []
    with np.errstate(over="ignore"):
        gram, have = mix64(ids.astype(np.uint64) + _M2), 1
        while have < k:
            step = min(have, k - have)
            gram = mix64(gram[: len(gram) - step] * _M1 + gram[step:])
            have += step
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    mask = np.zeros(n + 2, np.int8)
    mask[order[1:][same] + 1] = 1
    mask[order[:-1][same] + 1] = 1
    edges = np.flatnonzero(np.diff(mask))
    return [(s, e + k - 1) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e - s + k - 1 >= least]


class Extensions:
    """How far two places of a sequence agree, forwards and backwards, from names of its stretches of 2^j symbols."""

    def __init__(self, ids: np.ndarray) -> None:
        _, first = np.unique(ids, return_inverse=True)
        self.names, self.n = [first.astype(np.int64)], len(ids)
        size = 1
        while 2 * size <= self.n:
            last = self.names[-1]
            pair = last[: len(last) - size] * np.int64(self.n + 1) + last[size:]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
            size *= 2

    def same(self, a: np.ndarray, b: np.ndarray, j: int) -> np.ndarray:
        """Whether the stretches of 2^j symbols from a and b are there and equal."""
        name = self.names[j]
        ok = (a >= 0) & (b >= 0) & (a < len(name)) & (b < len(name))
        return ok & (name[np.where(ok, a, 0)] == name[np.where(ok, b, 0)])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree from a and b on."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            while (more := self.same(a + out, b + out, j)).any():
                out += more.astype(np.int64) << j
                if j < len(self.names) - 1:
                    break
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree before a and b."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            size = 1 << j
            while (more := self.same(a - out - size, b - out - size, j)).any():
                out += more.astype(np.int64) << j
                if j < len(self.names) - 1:
                    break
        return out


def main_lorentz(ids: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """start, length, period of the runs of ids, sorted by start, then period."""
    n, none = len(ids), np.zeros((0, 3), np.int64)
    if n < least:
        return none
    ext = Extensions(ids)
    # A run that crosses a middle has, on its longer side, at least half its length: so far its words agree with those q away.
    agree = min(max(-(-least // 2) - q, -(-power * q // 2) - q) for q in range(1, least + 1))
    j = max(0, agree.bit_length() - 1)
    size = 1 << j
    # Names of the stretches of `size` words; those that would end outside have none that another stretch has.
    name = np.concatenate([-1 - np.arange(size), ext.names[j], -1 - size - np.arange(size)])
    places, periods = [], []
    lo, hi = np.array([0]), np.array([n])
    while len(lo):
        mid = (lo + hi) // 2
        most = (hi - lo) // power
        first = np.cumsum(most) - most
        q = np.arange(int(most.sum())) - np.repeat(first, most) + 1
        after, before = np.repeat(mid + size, most), np.repeat(mid, most)
        right = np.flatnonzero(np.repeat(name[mid + size], most) == name[after + q])
        left = np.flatnonzero(np.repeat(name[mid], most) == name[before - q])
        places += [after[right] - size, before[left] - q[left]]
        periods += [q[right], q[left]]
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        lo, hi = lo[hi - lo >= least], hi[hi - lo >= least]
    at, period = np.concatenate(places), np.concatenate(periods)
    back = ext.behind(at, at + period)
    length = back + ext.ahead(at, at + period) + period
    ok = length >= np.maximum(least, power * period)
    found = [np.stack([(at - back)[ok], length[ok], period[ok]], axis=1)]
    runs = np.unique(np.concatenate([none, *found]), axis=0)
    # Sorted by start, length and period: of one stretch the first has the smallest period, and the others are its multiples.
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(words: list[bytes], least: int = LEAST, power: int = POWER) -> np.ndarray:
    """start, length, period of the runs of a document's words, sorted by start, then period."""
    n, none = len(words), np.zeros((0, 3), np.int64)
    if n < least:
        return none
    number: dict[bytes, int] = {}
    ids = np.fromiter(map(number.setdefault, words, range(n)), np.int64, n)
    if len(number) == n:
        return none
    out = [main_lorentz(ids[s:e], least, power) + np.array([s, 0, 0]) for s, e in repeated_stretches(ids, overlap(least, power), least)]
    runs = np.concatenate([none, *out])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def longest(runs: np.ndarray) -> tuple:
    """start, length, period and floor(1000 length / period) of the run of greatest length / period; nulls without runs."""
    best = None
    for s, n, q in runs.tolist():
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return (*best, 1000 * best[1] // best[2]) if best else (None,) * 4


_ARROW = {
    "bigint": pa.int64(), "string": pa.string(),
    "array<struct<start:bigint,length:bigint,period:bigint>>": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
}


def _judged(docs: DataFrame, text: str, planted: bool, least: int, power: int, row, schema: str) -> DataFrame:
    fields = StructType.fromDDL(schema).fields
    names = [f.name for f in fields]
    types = [_ARROW[f.dataType.simpleString()] for f in fields[1:]]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, rows = batch.slice(start, 512), []
                for h, body in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    words = bytes(body.as_buffer()).split() if body.is_valid else []
                    words = plant(words, h) if planted else words
                    rows.append(row(words, find_runs(words, least, power)))
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)

    at = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    return docs.select(F.col("doc_id").cast("long"), at.alias("h"), F.col(text).alias("text")).mapInArrow(judge, schema)



def runs_of(docs: DataFrame, text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words, the runs, and the text without their repeats, for each row."""

    def row(words: list[bytes], runs: np.ndarray) -> tuple:
        return len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], collapse(words, runs).decode()

    return _judged(docs, text, False, least, power, row, RUNS)


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Of the documents with their planted ends: number of runs, the one of greatest exponent, and digests, of SCHEMA."""

    def row(words: list[bytes], runs: np.ndarray) -> tuple:
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
        return len(runs), *longest(runs), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapse(words, runs)).hexdigest()

    return _judged(docs, text, True, LEAST, POWER, row, SCHEMA)
