"""Packing by length bucket: dynamic programming over the global length histogram places the bucket boundaries that
minimise padding; batches of a token budget form inside each bucket.

Defined results: a null or empty text has length 0 and goes to the first bucket; an empty table gives no rows; repeated
rows are packed one by one; ties are broken by row hash. A document longer than the budget is a batch of its own; a very
long text is one row's count. Columns other than doc_id and the text play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offersieve.llm.common import WORD, hold, row_hash


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds of at most `buckets` buckets with the least total padding; exact.

    cost(i, j) = lengths[j] * documents in i..j - tokens in i..j has the quadrangle inequality, so each layer of the
    program is solved by divide and conquer: O(buckets * lengths * log lengths).
    """
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.float64), counts[order].astype(np.float64)
    m = len(x)
    if not m:
        return []
    n = np.concatenate([[0.0], np.cumsum(c)])
    before = np.concatenate([[0.0], x * n[1:]])  # one bucket up to each length; the token sum is the same for any choice
    cuts = []
    for _ in range(1, min(buckets, m)):
        best, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        best[0] = 0.0
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(first, min(last, mid - 1) + 1)
            costs = before[i] + x[mid - 1] * (n[mid] - n[i])
            k = int(np.argmin(costs))
            best[mid], cut[mid] = costs[k], i[k]
            todo += [(lo, mid - 1, first, int(i[k])), (mid + 1, hi, int(i[k]), last)]
        cuts.append(cut)
        before = best
    out, at = [], m
    for cut in reversed(cuts):
        out.append(int(x[at - 1]))
        at = int(cut[at])
        if not at:
            break
    if at:
        out.append(int(x[at - 1]))
    return out[::-1]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 16384, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, bucket, bucket_length, batch_id, slot (place in its batch) and padding.

    A batch holds at most floor(budget / bucket_length) documents, one at least. Each bucket is dealt by row hash into
    groups of some dozens of batches, numbered within the group; so a bucket with a third of all rows is no hot task.
    """
    length = word_count(F.col(text)) if length is None else length
    sized = hold(docs.select("doc_id", row_hash("doc_id", text).alias("row"), length.alias("n_tokens")))
    # As k different lengths take k * (k - 1) / 2 units of text, their number grows with the root of the input only.
    rows = sized.groupBy(F.col("n_tokens").alias("x")).agg(F.count("*").alias("n")).collect()
    x, n = np.array([r["x"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    tops = boundaries(x, n, buckets)
    if not tops:
        tops = [0]
    per = [max(1, budget // max(1, t)) for t in tops]
    bucket_of = np.searchsorted(tops, x)
    held = [int(n[bucket_of == i].sum()) for i in range(len(tops))]
    salts = [max(1, h // max(1024, 32 * p)) for h, p in zip(held, per, strict=True)]
    table = F.array(*[F.struct(F.lit(t).cast("long").alias("top"), F.lit(p).cast("long").alias("per"), F.lit(s).cast("long").alias("salts")) for t, p, s in zip(tops, per, salts, strict=True)])
    bucket = F.lit(len(tops) - 1)
    for i in reversed(range(len(tops) - 1)):
        bucket = F.when(F.col("n_tokens") <= tops[i], F.lit(i)).otherwise(bucket)
    dealt = sized.withColumn("bucket", bucket).withColumn("b", F.get(table, F.col("bucket")))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("row", "doc_id", F.lit("salt")), F.col("b.salts")))
    place = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("row", "doc_id")) - 1
    dealt = dealt.withColumn("place", place)
    return dealt.select(
        "doc_id", "n_tokens", "bucket", F.col("b.top").alias("bucket_length"),
        F.concat_ws("-", "bucket", "salt", F.floor(F.col("place") / F.col("b.per"))).alias("batch_id"),
        (F.col("place") % F.col("b.per")).cast("long").alias("slot"), (F.col("b.top") - F.col("n_tokens")).alias("padding"),
    )
