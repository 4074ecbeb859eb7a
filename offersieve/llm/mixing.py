"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree parts exact source block quotas among
output shards; each shard then draws a stretch of its own from every source's permuted blocks, and shuffles locally.

A source's documents fall into up to BLOCKS blocks by a seeded hash. Its target is so many whole passes and a rest; the
rest takes the first blocks of the seeded permutation, and the block in which it ends gives single documents.

Defined results: sources are ordered by code point, null last, and weigh 1, 2, 3, repeating (or as given); a null or
empty text has size 0 and adds no words; a source without words has target 0; equal rows are interchangeable; an empty
table gives no rows; a very long text is one row's count. Kept columns pass through, whatever their names, but for one
named like a result, which gives way to the result. Every choice is a hash of seed, source and row, so reruns and lost tasks agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offersieve.llm.common import hold, materialize, row_hash
from offersieve.llm.packing import word_count

BLOCKS = 1024
RESULTS = ("m_size", "m_source_size", "m_target", "m_passes", "m_block", "m_shards", "m_orders")
MAX_PASSES = 3


def fill_targets(sizes: list[int], weights: list[float], total: float, most: float = MAX_PASSES) -> list[float]:
    """Shares of total by weight, none above `most` times its size; what is cut is shared again among the others."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources block counts: each node halves its shards and draws, without replacement, which of its blocks go
    left. Row sums differ by one at most, column sums are the quotas exactly."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        all_blocks = int(have.sum())
        to_left = (all_blocks * (mid - lo) + (hi - lo) // 2) // (hi - lo)
        rng = np.random.Generator(np.random.Philox(key=[seed, (lo << 32) | hi]))
        left = np.zeros_like(have)
        for i, n in enumerate(have):  # the multivariate draw, one conditional hypergeometric a source
            rest = all_blocks - int(n)
            left[i] = rng.hypergeometric(int(n), rest, to_left) if to_left and n else 0
            to_left -= int(left[i])
            all_blocks = rest
        down(lo, mid, left)
        down(mid, hi, have - left)

    if shards:
        down(0, shards, quotas.astype(np.int64))
    return out


def mix(docs: DataFrame, source: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",), weight: Callable[[int], float] = lambda i: 1.0 + i % 3, share: float = 1.0, shards: int = 64, seed: int = 17) -> DataFrame:
    """The columns `keep` of docs with m_size, m_source_size, m_target, m_passes (how often the mix takes the document),
    m_block and m_shards (for each pass, the output shard, and m_orders, the place key within it).

    Sources are few next to rows (one row each reaches the driver; more than 100,000 raise); every other step is
    by (source, block), of which a source with a third of all rows has BLOCKS.
    """
    block = F.pmod(F.xxhash64(F.lit(seed), "m_row"), F.lit(BLOCKS)).cast("int")
    whole_row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("m_doc")
    sized = docs.select(whole_row, F.col(source).alias("m_source"), row_hash("doc_id", text).alias("m_row"), word_count(F.col(text)).alias("m_size")).withColumn("m_block", block)
    sized = hold(sized)
    blocks = materialize(sized.groupBy("m_source", "m_block").agg(F.sum("m_size").alias("b_size")))
    totals = blocks.groupBy("m_source").agg(F.sum("b_size").alias("s_size"), F.count("*").alias("s_blocks")).limit(100_001).collect()
    if len(totals) > 100_000:
        raise ValueError("more than 100,000 sources: merge them first")
    totals = sorted(totals, key=lambda r: (r["m_source"] is None, r["m_source"] or ""))
    sizes = [r["s_size"] for r in totals]
    targets = fill_targets(sizes, [weight(i) for i in range(len(sizes))], share * sum(sizes))
    spark = docs.sparkSession
    plan = []
    whole = [min(MAX_PASSES, int(t // s)) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    for r, t, s, p in zip(totals, targets, sizes, whole, strict=True):
        plan.append((r["m_source"], s, float(t), p, float(t - p * s)))
    plan_df = spark.createDataFrame(plan, "m_source string, m_source_size long, m_target double, p_whole int, p_rest double") if plan else spark.createDataFrame([], "m_source string, m_source_size long, m_target double, p_whole int, p_rest double")

    by = Window.partitionBy("p.m_source").orderBy(F.xxhash64(F.lit(seed + 1), "b.m_block"), "b.m_block")
    ordered = (
        blocks.alias("b").join(plan_df.alias("p"), F.col("b.m_source").eqNullSafe(F.col("p.m_source")))
        .select(F.col("p.m_source").alias("p_source"), F.col("b.m_block").alias("p_block"), "b_size", "m_source_size", "m_target", "p_whole", "p_rest",
                F.row_number().over(by).alias("p_no"), F.sum("b_size").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                F.count("*").over(Window.partitionBy("p.m_source")).alias("p_blocks"))
        .withColumn("before", F.coalesce("before", F.lit(0)))
        .withColumn("p_in", F.when(F.col("before") + F.col("b_size") <= F.col("p_rest"), 2).when(F.col("before") < F.col("p_rest"), 1).otherwise(0))
    )
    ordered = materialize(ordered)
    # Blocks drawn, whole or in part, in all passes; the tree parts them among the shards.
    drawn = {r["p_source"]: r["q"] for r in ordered.groupBy("p_source").agg(F.sum((F.col("p_whole") + (F.col("p_in") > 0).cast("int")).cast("long")).alias("q")).collect()}
    quotas = split_quotas(np.array([drawn.get(r["m_source"], 0) for r in totals], np.int64), shards, seed)
    ends = spark.createDataFrame([(r["m_source"], np.cumsum(quotas[:, i]).tolist()) for i, r in enumerate(totals)], "e_source string, e_ends array<long>")

    placed = (
        sized.join(ordered, F.col("m_source").eqNullSafe(F.col("p_source")) & (F.col("m_block") == F.col("p_block")), "left")
        .join(F.broadcast(ends) if len(totals) * shards <= 1_000_000 else ends, F.col("m_source").eqNullSafe(F.col("e_source")), "left")
    )
    # In the block where the rest ends, documents are taken in hash order while the sum stays nearest to it.
    cut = Window.partitionBy("m_source", "m_block").orderBy(F.xxhash64(F.lit(seed + 2), "m_row"), "m_row")
    inside = F.coalesce(F.sum("m_size").over(cut.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    partial = placed.filter("p_in = 1").withColumn("more", (F.col("before") + inside + F.col("m_size") / 2 <= F.col("p_rest")).cast("int"))
    rest = placed.filter("p_in <> 1").withColumn("more", (F.col("p_in") == 2).cast("int"))
    out = rest.unionByName(partial).withColumn("m_passes", F.least(F.lit(MAX_PASSES), F.col("p_whole") + F.col("more")))
    # Pass k (from 0) of the block numbered no is draw k * blocks + no - 1 of its source; its shard is where the ends say.
    draws = F.transform(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1)), lambda k: k * F.col("p_blocks") + F.col("p_no") - 1)
    shard_of = F.transform(F.slice(draws, F.lit(1), F.col("m_passes")), lambda d: F.size(F.filter("e_ends", lambda e: e <= d)))
    order_of = F.transform(F.slice(draws, F.lit(1), F.col("m_passes")), lambda d: F.xxhash64(F.lit(seed + 3), d, "m_row"))
    others = (F.col(f"m_doc.`{c}`") for c in keep if c.lower() not in RESULTS)
    return out.select(*others, "m_size", "m_source_size", "m_target", "m_passes", "m_block", shard_of.alias("m_shards"), order_of.alias("m_orders"))


def write_order(mixed: DataFrame, shards: int = 64) -> DataFrame:
    """The mix itself, a row for each time a document is taken: shard by shard, shuffled within each."""
    rows = mixed.withColumn("m_take", F.explode(F.arrays_zip("m_shards", "m_orders"))).withColumns({"m_shard": F.col("m_take.m_shards"), "m_order": F.col("m_take.m_orders")})
    return rows.drop("m_take", "m_shards", "m_orders").repartition(shards, "m_shard").sortWithinPartitions("m_shard", "m_order")
