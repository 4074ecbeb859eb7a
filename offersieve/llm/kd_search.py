"""Exact top-k by inner product over integer vectors. Shards are cut in space by median splits of a bounded sample, and each
has a KD-tree of median splits with tight bounding boxes. A query first goes through the shards whose boxes bound its
product highest, best first within each, and takes its k-th best score along; it then goes only to those other shards
whose bound reaches that score.

Points that lie on one side of every split, such as many copies of one vector, are dealt by hash to several shards of
bounded size, so a tree never has more than twice SHARD_ROWS points, or 2 / MOST_SHARDS of all. The sample decides where
shards are cut, never what is found. The driver holds the sample and the shards' boxes: at most SAMPLE_BYTES and, for
MOST_SHARDS, a few thousand boxes.

Defined results: vectors that are null, or hold a null or a component that is not finite, take no part; a vector shorter
than the longest counts as zero beyond its end; other rows with the query's own id are no candidates; of repeated rows
each is a candidate; ties go to the smaller id, null last; a query with fewer than k candidates has fewer rows; scores
are exact while they fit a long. An empty table, or no queries, gives no rows; columns other than vec_id and embedding
play no part, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offersieve.llm.common import hold, materialize

LEAF = 64
SHARD_ROWS, MOST_SHARDS, BLOCK_ROWS = 4096, 4096, 1024
#: Of the sample that places the cuts: rows a shard and bytes; shards that a query visits first.
SAMPLE_ROWS, SAMPLE_BYTES, HOME = 64, 32 << 20, 2
#: Trees in a file.
TREE_ROWS = 16
NO_ID = np.iinfo(np.int64).max


class Tree:
    """Nodes in arrays; node 0 is the root, an inner node's children are at kids, a leaf's rows at rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray) -> None:
        order = np.arange(len(points))
        self.kids: list[tuple[int, int] | None] = []
        self.rows: list[tuple[int, int]] = []
        low, high = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            mine = points[order[lo:hi]]
            box = mine.min(0), mine.max(0)
            low.append(box[0])
            high.append(box[1])
            node = len(self.kids)
            self.kids.append(None)
            self.rows.append((lo, hi))
            if parent >= 0:
                a, b = self.kids[parent]
                self.kids[parent] = (node, b) if side == 0 else (a, node)
            axis = int(np.argmax(box[1] - box[0]))
            if hi - lo > LEAF and box[1][axis] > box[0][axis]:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(mine[:, axis], mid)]
                self.kids[node] = (-1, -1)
                todo += [(lo, lo + mid, node, 0), (lo + mid, hi, node, 1)]
        self.low, self.high = np.stack(low), np.stack(high)
        self.points, self.ids = points[order], ids[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the most that a product with a point in the box can be."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, queries: np.ndarray, ids: np.ndarray, reached: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, its best scores of at least `reached` and their ids, best first."""
    bound, out = tree.bounds(queries), []
    for i, q in enumerate(queries):
        scores, names = np.zeros(0, queries.dtype), np.zeros(0, np.int64)
        kth, b = reached[i], bound[i]
        heap = [(-b[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < kth:
                break  # every box that is left is farther still; an equal one may hold a smaller id
            kids = tree.kids[node]
            if kids is not None:
                for c in kids:
                    if b[c] >= kth:
                        heapq.heappush(heap, (-b[c], c))
                continue
            lo, hi = tree.rows[node]
            got = tree.points[lo:hi] @ q
            fit = (got >= kth) & (tree.ids[lo:hi] != ids[i])
            if fit.any():
                scores, names = np.concatenate([scores, got[fit]]), np.concatenate([names, tree.ids[lo:hi][fit]])
                order = np.lexsort((names, -scores))[:k]
                scores, names = scores[order], names[order]
                kth = max(kth, scores[-1]) if len(scores) == k else kth
        out.append((scores, names))
    return out


def cuts(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Median splits of the sample, widest axis first, until there are `leaves` cells: (axis, value, child, child), where
    a child of at least 0 is another split and ~i is cell i."""
    out: list[list] = []

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal cell
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(1)
        axis = int(np.argmax(spread))
        if want < 2 or not spread[axis]:
            cell += 1
            return ~(cell - 1)
        value = float(np.median(rows[:, axis]))
        left = rows[:, axis] < value
        if not left.any():
            value = float(rows[rows[:, axis] > value, axis].min())
            left = rows[:, axis] < value
        here = len(out)
        out.append([axis, value, 0, 0])
        out[here][2] = grow(rows[left], want // 2)
        out[here][3] = grow(rows[~left], want - want // 2)
        return here

    cell = 0
    grow(sample, leaves)
    return [tuple(x) for x in out]


def cells(points: np.ndarray, splits: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The cell of each point."""
    at = np.full(len(points), 0 if splits else ~0)
    for node, (axis, value, left, right) in enumerate(splits):  # children come after their parents
        here = at == node
        at[here] = np.where(points[here, axis] < value, left, right)
    return ~at


def _numbers(lists, width: int) -> np.ndarray:
    """Rows of longs as a matrix: doubles where every product is exact in them, else longs."""
    flat = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    sizes = np.array([len(x) for x in lists], np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. Shards are built once and written; a task has one shard and at most BLOCK_ROWS
    queries, and gives at most k rows a query, which meet by query."""

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        finite = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        return df.filter(finite).select(F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))

    spark = vectors.sparkSession
    points, asked = hold(whole(vectors)), hold(whole(queries))
    n, width, far = points.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    m, width_q, far_q = asked.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    dims = max(width or 0, width_q or 0, 1)
    kind = np.float64 if dims * max(far or 0, 1) * max(far_q or 0, 1) < 1 << 53 else np.int64
    shard_rows = max(shard_rows, -(-n // MOST_SHARDS))
    leaves, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // BLOCK_ROWS))
    wanted = min(SAMPLE_ROWS * leaves, SAMPLE_BYTES // (8 * dims))
    sampled = points.filter(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, n // max(1, wanted)))) == 0).limit(2 * wanted) if leaves > 1 else points.limit(0)
    splits = cuts(_numbers([r.v for r in sampled.select("v").collect()], dims), leaves)

    def place(batches):
        for batch in batches:
            at = cells(_numbers(batch.column(1).to_pylist(), dims), splits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64())], names=["id", "v", "cell"])

    placed = hold(points.mapInArrow(place, "id long, v array<long>, cell long"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / shard_rows).cast("int").alias("deal"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("deal", F.pmod(F.xxhash64("v", "id"), "deal"))

    def build(key: tuple, here: pd.DataFrame) -> pd.DataFrame:
        p = _numbers(list(here.v), dims).astype(kind)
        ids = here.id.astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        tree = Tree(p, ids)
        return pd.DataFrame({"cell": [key[0]], "deal": [key[1]], "low": [tree.low[0].tobytes()], "high": [tree.high[0].tobytes()], "tree": [pickle.dumps(tree)]})

    index = materialize(dealt.groupBy("cell", "deal").applyInPandas(build, "cell long, deal long, low binary, high binary, tree binary"), TREE_ROWS)
    boxes = index.select("cell", "deal", "low", "high").orderBy("cell", "deal").collect()
    named = [(r.cell, r.deal) for r in boxes]
    low, high = (np.frombuffer(b"".join(getattr(r, x) for r in boxes), kind).reshape(-1, dims) for x in ("low", "high"))
    boxes_of = spark.sparkContext.broadcast((np.array(named, np.int64).reshape(-1, 2), low, high))

    def visits(first: bool):
        """(cell, deal, block, id, v, reached) for each shard that a query goes to first, or later."""

        def give(batches):
            names, low, high = boxes_of.value
            for batch in batches:
                for start in range(0, batch.num_rows if len(names) else 0, 256):
                    part = batch.slice(start, 256)
                    q = _numbers(part.column(1).to_pylist(), dims).astype(kind)
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    homes = np.argsort(-bound, axis=1, kind="stable")[:, :HOME]
                    go = np.zeros(bound.shape, bool)
                    np.put_along_axis(go, homes, True, 1)
                    if not first:
                        go = ~go & (bound >= part.column(3).to_numpy(zero_copy_only=False)[:, None])
                    row, shard = np.nonzero(go)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(names[shard, 0]), pa.array(names[shard, 1]), *(part.column(c).take(take) for c in (2, 0, 1, 3))], names=["cell", "deal", "block", "id", "v", "reached"])

        return give

    def one(key: tuple, trees: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        cols = {"query_id": [], "vec_id": [], "score": []}
        if len(trees) and len(there):
            ids = there.id.astype("Int64").fillna(NO_ID).to_numpy(np.int64)
            q = _numbers(list(there.v), dims).astype(kind)
            for i, (scores, names) in enumerate(search(pickle.loads(trees.tree.iloc[0]), q, ids, there.reached.to_numpy(), k)):
                cols["query_id"].append(np.full(len(names), ids[i]))
                cols["vec_id"].append(names)
                cols["score"].append(scores.astype(np.int64))
        return pd.DataFrame({c: np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for c, v in cols.items()})

    key = ["cell", "deal", "block"]

    def found(queries: DataFrame, first: bool) -> DataFrame:
        going = hold(queries.select("id", "v", "block", "reached").mapInArrow(visits(first), "cell long, deal long, block int, id long, v array<long>, reached double"))
        pairs = going.select(*key).distinct().toDF("t_cell", "t_deal", "t_block")
        trees = index.select(F.col("cell").alias("t_cell"), F.col("deal").alias("t_deal"), "tree").join(pairs, ["t_cell", "t_deal"])
        return trees.groupBy("t_cell", "t_deal", "t_block").cogroup(going.groupBy(*key)).applyInPandas(one, "query_id long, vec_id long, score long")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)

    no = F.lit(int(NO_ID))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("v", "id"), F.lit(blocks)).cast("int"))
    near = hold(found(asked.withColumn("reached", F.lit(float("-inf"))), True))
    # of rows with one id any may have the k-th score, so the least counts
    kth = best(near).filter(F.col("rank") == k).groupBy("query_id").agg(F.min("score").cast("double").alias("kth"))
    asked = asked.join(kth, F.coalesce("id", no) == F.col("query_id"), "left").withColumn("reached", F.coalesce("kth", F.lit(float("-inf"))))
    ranked = best(near.union(found(asked, False)))
    return ranked.select(F.nullif("query_id", no).alias("query_id"), "rank", F.nullif("vec_id", no).alias("vec_id"), "score")
