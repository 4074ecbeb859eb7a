"""Word shingles of Arrow batches, by numpy over the bytes of a whole batch; no per-word Python."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C52F, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)]
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACED = np.random.Generator(np.random.PCG64(11)).integers(0, (1 << 64) - 1, (64, 256), dtype=np.uint64, endpoint=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_PRIME = np.uint64((1 << 31) - 1)
#: Random points, whose powers run through all residues, of the hash of anchors and of that of whole contexts, two each.
ANCHOR, WHOLE = (1849842305, 2018595600), (1208042420, 1297780820)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _MUL
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^31 - 1; tables of usual lengths are kept."""
    return _powers(base, 1 << max(n - 1, 0).bit_length())[:n] if n <= 1 << 18 else _powers.__wrapped__(base, n)


@lru_cache(64)
def _powers(base: int, n: int) -> np.ndarray:
    """By doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, top = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(top) % _PRIME
        have += more
        top = top * top % int(_PRIME)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


class Rolling:
    """Hashes of any stretch of symbols in O(1): prefix sums of polynomials over mixed grams of `gram` symbols, modulo the
    prime 2^31 - 1 at two random points, each over its own bits of the grams. Modulo a power of two every odd base has
    powers that differ by multiples of large powers of two, and texts in the order of Thue and Morse collide, of bytes as
    of grams; modulo a prime there is no such order. Two texts of n symbols that differ agree at both points with a chance
    of at most (n / 2^31)^2. A stretch has at least `gram` symbols."""

    def __init__(self, mixed: np.ndarray, gram: int, points: tuple[int, int]) -> None:
        n = len(mixed)
        self.gram, self.size = gram, n + gram - 1
        self.sums, self.back = [], []
        for point, value in zip(points, (mixed >> np.uint64(33), mixed & _PRIME), strict=True):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_fold(value * powers(point, n)), out=sums[1:])  # under 2^32 each, so no sum overflows
            self.sums.append(sums)
            self.back.append(powers(pow(point, -1, int(_PRIME)), n + 1))

    def _mixed(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = None
        for differ, back in parts:
            r = _fold(_fold(_fold(differ) * back))
            r = np.where(r >= _PRIME, r - _PRIME, r)
            out = r if out is None else out << np.uint64(32) | r
        with np.errstate(over="ignore"):
            return mix64(out)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        last = end - self.gram + 1
        return self._mixed([(s[last] - s[start], b[start]) for s, b in zip(self.sums, self.back, strict=True)])

    def all(self, width: int) -> np.ndarray:
        """Of every stretch of `width` symbols."""
        step = width - self.gram + 1
        return self._mixed([(s[step:] - s[: len(s) - step], b[: len(s) - step]) for s, b in zip(self.sums, self.back, strict=True)])


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number that is the same modulo 2^31 - 1."""
    return (x & _PRIME) + (x >> np.uint64(31))


def byte_grams(raw: np.ndarray) -> np.ndarray:
    """Mixed grams of 8 bytes."""
    x = raw.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[: max(0, len(x) - k)] | (x[k:] << np.uint64(8 * k))
    with np.errstate(over="ignore"):
        return mix64(x ^ _STEPS[0])


def word_grams(hashes: np.ndarray) -> np.ndarray:
    """Mixed grams of 4 words."""
    n = max(0, len(hashes) - 3)
    with np.errstate(over="ignore"):
        return mix64(sum(hashes[k : k + n] * _STEPS[k] for k in range(4)))


def word_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of anything but ASCII white space; none crosses an offset."""
    n = len(raw)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = _GAP[raw]
    # A row's first byte starts a word even where the row before ends in one.
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~gap[1:-1]
    return np.flatnonzero(word & (gap[:-2] | edge[:-1])), np.flatnonzero(word & (gap[2:] | edge[1:])) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word: the sum of a random number for each byte and place in the word, mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1])
    byte = raw[place + np.repeat(starts - first, sizes)]
    place -= np.repeat(first, sizes)
    far = np.flatnonzero(place >= len(_PLACED))
    with np.errstate(over="ignore"):
        value = _PLACED.ravel()[(np.minimum(place, len(_PLACED) - 1) << 8) | byte]
        value[far] = mix64(_BYTE[byte[far]] + place[far].astype(np.uint64) * _MUL)
        return mix64(np.add.reduceat(value, first) + sizes.astype(np.uint64) * _STEPS[1])


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text, so that memory stays bounded however Arrow cut them."""
    for batch in batches:
        offsets = text_bytes(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, row after row and sorted within each, and the offsets of the rows.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A row of fewer than `width` words has its whole
    sequence as its one shingle; a row without words has none. Hashes have 64 bits.
    """
    raw, offsets = text_bytes(column)
    raw = _LOWER[raw]
    rows = len(offsets) - 1
    starts, ends = word_places(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    first = np.searchsorted(starts, offsets)  # index of each row's first word
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        total = hashes[: max(0, len(hashes) - width + 1)] * _STEPS[0]
        for k in range(1, width):
            total = total + hashes[k : len(hashes) - width + 1 + k] * _STEPS[k]
    grams = mix64(total)
    out, sizes = [], np.zeros(rows, np.int64)
    for i in range(rows):
        c = counts[i]
        if c >= width:
            mine = np.sort(grams[first[i] : first[i] + c - width + 1])
            mine = mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
        elif c:
            with np.errstate(over="ignore"):
                mine = mix64(np.array([np.sum(hashes[first[i] : first[i] + c] * np.array(_STEPS[:c])) + np.uint64(c)], np.uint64))
        else:
            continue
        out.append(mine)
        sizes[i] = len(mine)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
