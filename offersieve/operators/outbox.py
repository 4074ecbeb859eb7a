"""Sinks that a replayed batch leaves as they are, and the queue of replies that lies on them.

Defined results: a batch that is written again replaces itself; a key that comes in several batches keeps its row of the first
one, and within a batch the least by `order`; rows with a null key are one key. A reader may see part of a batch while
it is being written, never after. Attempts without a reply are ignored, as are those after a reply's end; a null or
unknown outcome is a failure that may be tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: A reply is tried so often, and so many of a user's replies are sent at a time.
MOST_ATTEMPTS = 5
DRAIN = 20
ERROR_CHARS = 500


class BatchLog:
    """An append-only table below one folder, a folder a batch; `append` is fit for foreachBatch."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def append(self, rows: DataFrame, batch: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/batch={batch}")

    def rows(self, key: list[str], order: list[str]) -> DataFrame:
        """One row a key, with the batch it came in: partial aggregates first, so copies of a key don't meet in one task."""
        kept = self.spark.read.schema(StructType(self.schema.fields).add("batch", "long")).parquet(self.root)
        rest = [c for c in kept.columns if c not in key]
        first = F.min_by(F.struct(*rest), F.struct("batch", *order)).alias("r")
        return kept.groupBy(*key).agg(first).select(*key, "r.*").select(*kept.columns)


def reply_state(replies: DataFrame, attempts: DataFrame, order: list[str]) -> DataFrame:
    """reply_id, user_id, operation, target, status (open, sent or dropped), attempts, last_error.

    replies: reply_id, user_id, operation (send or edit), target. attempts: reply_id, outcome (sent, permanent, stale or
    another), error, in the order of `order`. An edit whose message is gone (stale) becomes a send, once and for good, which
    counts as an attempt; stale is permanent for a send. What fails for the fifth time is dropped. At most six attempts
    of a reply count, as a fifth one that turns an edit into a send is followed by one more; the window keeps no others, and
    the first of them takes the rest beside it, so that they need no second sort to be one row."""
    of = Window.partitionBy("reply_id").orderBy(*order)
    nth = F.row_number().over(of)
    tried = attempts.select("reply_id", "outcome", F.substring("error", 1, ERROR_CHARS).alias("error"), *[c for c in order if c not in ("reply_id", "outcome", "error")])
    tried = tried.withColumn("no", nth).filter(F.col("no") <= MOST_ATTEMPTS + 1)
    one = F.struct("no", F.coalesce("outcome", F.lit("")).alias("outcome"), "error")
    tried = tried.withColumn("tries", F.array_compact(F.array(one, *[F.lead(one, i).over(of) for i in range(1, MOST_ATTEMPTS + 1)]))).filter("no = 1").select("reply_id", "tries")
    j = replies.select("reply_id", "user_id", "operation", "target").join(tried, "reply_id", "left")
    turn = F.when(F.col("operation") == "edit", F.array_min(F.transform(F.filter("tries", lambda t: t["outcome"] == "stale"), lambda t: t["no"])))
    j = j.withColumn("turn", turn)
    failed = lambda t: (t["no"] >= MOST_ATTEMPTS) & (t["outcome"] != "sent")
    ends = lambda t: t["outcome"].isin("sent", "permanent") | (((t["outcome"] == "stale") | failed(t)) & ~F.coalesce(t["no"] == F.col("turn"), F.lit(False)))
    j = j.withColumn("end", F.get(F.filter("tries", ends), F.lit(0)))
    counted = F.coalesce(F.col("end.no"), F.size("tries"))
    turned = F.coalesce(F.col("turn") <= counted, F.lit(False))
    sent = F.col("end.outcome") == "sent"
    # the last failure's error: a reply that is sent keeps the one before
    errors = F.filter("tries", lambda t: (t["no"] <= counted) & (t["outcome"] != "sent"))
    return j.select(
        "reply_id", "user_id", F.when(turned, "send").otherwise(F.col("operation")).alias("operation"), F.when(~turned, F.col("target")).alias("target"),
        F.when(F.col("end").isNull(), "open").when(sent, "sent").otherwise("dropped").alias("status"),
        F.when(F.col("tries").isNull(), 0).otherwise(counted).cast("long").alias("attempts"), F.try_element_at(errors, F.lit(-1))["error"].alias("last_error"))


def next_replies(state: DataFrame, limit: int = DRAIN) -> DataFrame:
    """Each user's first `limit` open replies in their order, with their place: one that fails holds up those behind it."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("reply_id"))
    return state.filter("status = 'open'").withColumn("place", place).filter(F.col("place") <= limit)
