"""Connected components of a link table, by contraction; labels are the smallest node id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offersieve.llm.common import materialize, release, rows_of


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, label: a row for each node that has a link to another node.

    Each round every node takes the smallest neighbour's id, ids are followed once more, and links are redrawn between
    the labels; those within a label go. A node that is no local minimum disappears, so rounds are logarithmic. Minima
    are summed before the shuffle. Every round ends in tables in the shared folder: a lost executor costs one round. Ids
    may be of any type that has an order.
    """
    pairs = links.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).filter("a <> b").distinct()
    pairs = materialize(pairs)
    label = None
    while label is None or rows_of(pairs):
        both = pairs.union(pairs.select("b", "a"))
        step = both.groupBy(F.col("a").alias("old")).agg(F.least(F.min("b"), F.col("old")).alias("new"))
        further = step.select(F.col("old").alias("new"), F.col("new").alias("newer"))
        moved = step.join(further, "new", "left").select("old", F.coalesce("newer", "new").alias("to"))
        if label is None:
            relabelled = materialize(moved.toDF("node", "label"))
            moved = relabelled.toDF("old", "to")
        else:
            relabelled = materialize(label.join(moved.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
            release(label)
        to_a, to_b = moved.toDF("a", "ta"), moved.toDF("b", "tb")
        redrawn = materialize(pairs.join(to_a, "a").join(to_b, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        release(pairs)
        pairs, label = redrawn, relabelled
    release(pairs)
    return label
