"""Language ID: an interpolated Kneser-Ney character model per language, in sorted arrays; the language with the lowest
length-normalised cross-entropy is chosen, with calibrated rejection.

Letters are lower-cased, every run of other characters is one space. Counts are of 4-grams over all training texts;
models of the lower orders come from the continuation counts. Of documents with crc32(doc_id) mod 5 = r: r = 0 is held
out, r = 1 calibrates, the others are counted.

All languages and all counts are used. A model of more than PAIRS counts is split into parts, by languages and by the
last character but one of a 4-gram: a part holds whole what its 4-grams need of the orders above the first, whose counts,
like the discounts, are of all parts. Texts are read once for each part and its sums of log probabilities are added up.

Defined results: a null text, or one without letters, is `und` with score 0; a document without lang is predicted but
teaches nothing; a null doc_id counts as the empty text in crc32, so it is held out; repeated rows count each; ties go
to the smaller code; without training rows every text is `und`, and an empty table gives no rows. A very long text is one row's work, in some
tens of bytes a byte. Columns other than doc_id, text and lang play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.llm.common import hold, materialize, release, row_hash
from offersieve.llm.shingles import pieces

ORDER = 4
#: Of one part of the model, broadcast at a time: counts, counts times languages, and languages.
PAIRS, CELLS, GROUP = 2_000_000, 1 << 24, 16
_U16 = np.uint64(16)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: what a letter becomes (16 bits; those beyond fold into 0xE000 to 0xF8FF), 32 for all others."""
    fold, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            low = ord(low) if len(low) == 1 else c
            fold[c] = low if low < 0x10000 else 0xE000 + low % 0x1900
            letter[c] = True
    return fold, letter


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of each text's normal form, 16 bits a character, row after row, and the offsets of the rows."""
    fold, letter = _tables()
    joined = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t or "") for t in texts])
    is_letter = letter[joined]
    # a space stays only after a letter, and the first character of a text has no character before it
    keep = is_letter.copy()
    if len(joined):
        before = np.concatenate([[False], is_letter[:-1]])
        before[(ends[:-1])[ends[:-1] < len(joined)]] = False
        keep |= before
    chars = fold[joined[keep]].astype(np.uint64)
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends]).astype(np.int64)]
    sizes = np.diff(kept)
    # three spaces stand before each text
    at = np.arange(len(chars)) + np.repeat(3 * np.arange(1, len(texts) + 1), sizes)
    padded = np.full(len(chars) + 3 * len(texts), 32, np.uint64)
    padded[at] = chars
    key = (padded[at - 3] << np.uint64(48)) | (padded[at - 2] << np.uint64(32)) | (padded[at - 1] << _U16) | padded[at]
    return key, kept


def count_grams(training: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, key, n over all rows; each task adds up its own counts before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in pieces(batches, 0):
            names = np.array(batch.column(1).to_pylist(), object)
            texts = np.array(batch.column(0).to_pylist(), object)
            for name in dict.fromkeys(names):
                key = np.unique(grams(list(texts[names == name]))[0], return_counts=True)
                mine = held.setdefault(name, [])
                mine.append(key)
                if sum(len(k) for k, _ in mine) > 1 << 20:
                    held[name] = [added(mine)]
                    if len(held[name][0][0]) > 1 << 20:
                        yield rows(name, held.pop(name)[0])
        for name, mine in held.items():
            yield rows(name, added(mine))

    def rows(name: str, counted: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        key, n = counted
        return pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])

    return training.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def _cut(key: np.ndarray, characters: int) -> np.ndarray:
    """The last `characters` characters of keys."""
    return key & np.uint64((1 << (16 * characters)) - 1) if characters < 4 else key


class Model:
    """For each order: sorted keys with log probabilities by language, and sorted contexts with log back-off weights.

    Of some languages, and of the 4-grams whose last character but one is in lo..hi - 1; first orders, discounts (lowest
    order first) and vocabulary are of all counts.
    """

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], first: dict[str, tuple[np.ndarray, np.ndarray]], discounts: dict[str, list[float]], vocabulary: int, lo: int = 0, hi: int = 1 << 16) -> None:
        self.langs, self.lo, self.hi = langs, lo, hi
        levels: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for name in langs:
            order = np.argsort(counts[name][0])
            level = [(counts[name][0][order], counts[name][1][order].astype(np.float64))]
            for k in range(ORDER - 1, 1, -1):  # N1+(. w): in how many contexts of one more character
                key, n = np.unique(_cut(level[-1][0], k), return_counts=True)
                level.append((key, n.astype(np.float64)))
            level.append((first[name][0], first[name][1].astype(np.float64)))
            levels.append(level[::-1])
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        for k in range(ORDER):
            keys = np.unique(np.concatenate([lv[k][0] for lv in levels]))
            contexts = np.unique(np.concatenate([lv[k][0] >> _U16 for lv in levels]))
            logp, weight = np.zeros((len(keys), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
            for i, lv in enumerate(levels):
                mine, n = lv[k]
                d = discounts[langs[i]][k]
                ctx, where = np.unique(mine >> _U16, return_inverse=True)
                total, kinds = np.bincount(where, n), np.bincount(where).astype(np.float64)
                back = np.ones(len(contexts))
                back[np.searchsorted(contexts, ctx)] = d * kinds / total
                own = np.zeros(len(keys))
                own[np.searchsorted(keys, mine)] = np.maximum(n - d, 0) / total[where]
                lower = np.exp(self._level(k - 1, _cut(keys, k))[:, i]) if k else np.full(len(keys), 1 / vocabulary)
                logp[:, i] = np.log(own + back[np.searchsorted(contexts, keys >> _U16)] * lower)
                weight[:, i] = np.log(back)
            self.keys.append(keys)
            self.logp.append(logp)
            self.contexts.append(contexts)
            self.weight.append(weight)
        self.floor = float(-np.log(vocabulary))

    def _level(self, k: int, key: np.ndarray) -> np.ndarray:
        """Log probabilities of order k + 1, a row a key and a column a language."""
        if k < 0:
            return np.full((len(key), len(self.langs)), self.floor, np.float32)
        at = np.searchsorted(self.keys[k], key)
        at[at == len(self.keys[k])] = 0
        out = self.logp[k][at]
        new = np.flatnonzero(self.keys[k][at] != key)
        if len(new):
            ctx = key[new] >> _U16
            where = np.searchsorted(self.contexts[k], ctx)
            where[where == len(self.contexts[k])] = 0
            seen = self.contexts[k][where] == ctx
            out[new] = self._level(k - 1, _cut(key[new], k)) + np.where(seen[:, None], self.weight[k][where], 0)
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the part's 4-grams, summed by text and language, and the length of each normal form."""
        key, offsets = grams(texts)
        sizes = np.diff(offsets)
        out = np.zeros((len(texts), len(self.langs)))
        some = sizes > 0
        if some.any():
            middle = (key >> _U16) & np.uint64(0xFFFF)
            mine = (middle >= self.lo) & (middle < self.hi)
            logp = self._level(ORDER - 1, key) if mine.all() else np.zeros((len(key), len(self.langs)), np.float32)
            if not mine.all():
                logp[mine] = self._level(ORDER - 1, key[mine])
            out[some] = np.add.reduceat(logp, offsets[:-1][some], axis=0, dtype=np.float64)
        return out, sizes


def ranges(sizes: dict[int, int], langs: int, pairs: int = PAIRS, cells: int = CELLS) -> list[tuple[int, int]]:
    """All characters in ranges, lo to hi - 1, that hold as many counts as a part may, or one character."""
    most = min(pairs, cells // langs)
    starts, held = [0], 0
    for c in sorted(sizes):
        if held and held + sizes[c] > most:
            starts.append(c)
            held = 0
        held += sizes[c]
    return list(zip(starts, [*starts[1:], 1 << 16], strict=True))


def train(training: DataFrame, text: str = "text", lang: str = "lang", pairs: int = PAIRS, cells: int = CELLS, group: int = GROUP) -> tuple[list[str], int, Iterator[Model]]:
    """The languages, the number of parts, and the parts, each made when it is asked for."""
    counts = materialize(count_grams(training, text, lang))
    middle = F.shiftrightunsigned("key", 16).bitwiseAND(0xFFFF)
    sizes: dict[str, dict[int, int]] = {}
    for r in counts.groupBy("lang", middle.alias("c")).count().collect():
        sizes.setdefault(r["lang"], {})[r["c"]] = r["count"]
    langs = sorted(sizes)
    discounts: dict[str, list[float]] = {name: [] for name in langs}
    level = counts
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # N1+(. w): in how many contexts of one more character
            level = level.groupBy("lang", F.col("key").bitwiseAND((1 << (16 * k)) - 1).alias("key")).agg(F.count("*").alias("n"))
        for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
            discounts[r["lang"]].insert(0, r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] and r["twice"] else 0.5)
    first = _by_lang(level.orderBy("key"), langs)
    vocabulary = len(np.unique(np.concatenate([k for k, _ in first.values()]))) + 1 if langs else 1
    parts = []
    for i in range(0, len(langs), group):
        some = langs[i : i + group]
        total: dict[int, int] = {}
        for name in some:
            for c, n in sizes[name].items():
                total[c] = total.get(c, 0) + n
        parts += [(some, lo, hi) for lo, hi in ranges(total, len(some), pairs, cells)]

    def models() -> Iterator[Model]:
        for some, lo, hi in parts:
            mine = counts if len(parts) == 1 else counts.filter(F.col("lang").isin(some) & (middle >= lo) & (middle < hi))
            yield Model(some, _by_lang(mine, some), first, discounts, vocabulary, lo, hi)

    return langs, len(parts), models()


def _by_lang(counts: DataFrame, langs: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of each language."""
    table = counts.select("lang", "key", "n").toArrow().combine_chunks()
    names = table.column("lang").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    place = {name: i for i, name in enumerate(names.dictionary.to_pylist())}
    which, key, n = names.indices.to_numpy(), table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    return {x: (key[which == place.get(x, -1)], n[which == place.get(x, -1)]) for x in langs}


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


FIELDS = "doc_id long, fold long, lang string, pred string, xe double, margin double"


def _decided(batch: pa.RecordBatch, langs: list[str], sums: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """The first three columns of a batch with prediction, cross-entropy in nats a character, and margin."""
    letters = sizes > 0
    xe = np.full(sums.shape, np.inf)
    xe[letters] = -sums[letters] / sizes[letters][:, None]
    ranked = np.sort(xe, axis=1)
    second = ranked[:, 1] if xe.shape[1] > 1 else ranked[:, 0] + 1
    pred = np.where(letters, np.array(langs, object)[xe.argmin(1)], "und")
    with np.errstate(invalid="ignore"):
        cols = [pa.array(pred.tolist(), pa.string()), pa.array(ranked[:, 0], pa.float64(), mask=~letters), pa.array(second - ranked[:, 0], pa.float64(), mask=~letters)]
    return pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["doc_id", "fold", "lang", "pred", "xe", "margin"])


def _scorer(shared, langs: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3, 1 << 20):
            yield _decided(batch, langs, *shared.value.sums(batch.column(3).to_pylist()))

    return score


def _in_parts(cols: DataFrame, models: Iterator[Model], langs: list[str]) -> DataFrame:
    """The same from one pass over the texts for each part of the model; repeated rows have the same sums."""
    keyed = cols.withColumn("row", row_hash("doc_id", "text"))
    tables = []
    for i, model in enumerate(models):
        shared = cols.sparkSession.sparkContext.broadcast(model)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 1, 1 << 20):
                sums, sizes = shared.value.sums(batch.column(1).to_pylist())
                out = np.zeros((len(sums), len(langs)))
                out[:, [langs.index(x) for x in shared.value.langs]] = sums
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64())), pa.array(sizes.astype(np.int64))], names=["row", "sums", "size"])

        tables.append(materialize(keyed.select("row", "text").mapInArrow(add, "row long, sums array<double>, size long").withColumn("part", F.lit(i))))
        shared.destroy()
    one = reduce(DataFrame.union, tables).groupBy("row", "part").agg(F.first(F.struct("sums", "size")).alias("s"))
    every = one.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("part", "s.sums"))).alias("parts"), F.first("s.size").alias("size"))
    zero = F.array_repeat(F.lit(0.0), len(langs))
    added_up = F.aggregate("parts", zero, lambda a, p: F.zip_with(a, p["sums"], lambda x, y: x + y))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _decided(batch, langs, np.array(batch.column(3).to_pylist(), np.float64), batch.column(4).to_numpy())

    whole = keyed.drop("text").join(every.select("row", added_up.alias("sums"), "size"), "row").select("doc_id", "fold", "lang", "sums", "size")
    return whole.mapInArrow(decide, FIELDS)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", bins: int = 200, pairs: int = PAIRS, cells: int = CELLS, group: int = GROUP) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, margin, accepted.

    Score is how often the calibration documents whose margin over the second language was as large were right, made
    monotone; a prediction is accepted if that is at least 1/2 and its cross-entropy is not far from theirs.
    """
    fold = fold_of(F.col("doc_id"))
    langs, n_parts, models = train(docs.filter((fold >= 2) & F.col(lang).isNotNull()), text, lang, pairs, cells, group)
    if not langs:
        return docs.select("doc_id", (fold == 0).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(None).cast("double").alias("margin"), F.lit(False).alias("accepted"))
    cols = docs.select(F.col("doc_id").cast("long"), fold.alias("fold"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    if n_parts == 1:
        scored = hold(cols.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(next(models)), langs), FIELDS))
    else:
        scored = hold(_in_parts(cols, models, langs))
    bin_of = F.least(F.lit(bins - 1), F.floor(F.col("margin") * 100)).cast("int")
    right = (F.col("pred") == F.col("lang")).cast("double")
    judged = scored.filter("fold = 1 AND lang IS NOT NULL AND margin IS NOT NULL")
    rates = {r["bin"]: r for r in judged.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.sum(right).alias("k")).collect()}
    spread = judged.filter("pred = lang").agg(F.avg("xe").alias("m"), F.stddev_pop("xe").alias("s")).first()
    curve, best = [], 0.0
    for i in range(bins):
        r = rates.get(i)
        if r:
            best = max(best, (r["k"] + 1) / (r["n"] + 2))
        curve.append(best)
    limit = spread["m"] + 6 * spread["s"] + 0.1 if spread["m"] is not None else float("inf")
    value = F.when(F.col("margin").isNull(), F.lit(0.0)).otherwise(F.get(F.array(*[F.lit(float(x)) for x in curve]), bin_of))
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), F.col("pred").alias("lang_pred"), value.alias("score"), F.col("xe").alias("cross_entropy"), "margin", F.coalesce((value >= 0.5) & (F.col("xe") <= limit), F.lit(False)).alias("accepted"))
