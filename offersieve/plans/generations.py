"""The alias index over generations: what it serves before and after new aliases take over, with its SQL."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.functions import text as X
from offersieve.operators.generations import AliasIndex
from offersieve.operators.lineage import _delete, shared_dir
from offersieve.plans.offers import ALIASES, DOCS, GROUPS, _read, _sig, sql_canonical

QUERIES: dict = {}
ORACLE: dict = {}

#: The aliases before the change: one group fewer, the other with one variant fewer.
EARLIER = {"de la": ["que"]}
LIMIT = 400


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _index(spark: SparkSession, sf_dir: str) -> tuple[AliasIndex, DataFrame]:
    """An index whose aliases changed while it grew: half of the documents stood when the change was asked for, the others came
    while its index was built. Also what the earlier generation said of all documents, just before the swap."""
    root = f"{shared_dir(spark)}/offersieve-generations-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, root)
    middle = _read(spark, sf_dir, "documents").agg(F.coalesce(F.max("doc_id") / 2, F.lit(0.0)).alias("m")).first()["m"]
    docs = _sig(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("sig").alias("tokens"))
    index = AliasIndex(spark, root)
    index.start(EARLIER)
    index.insert(docs.filter(F.col("id") <= middle), 0)
    index.start(ALIASES)
    index.insert(docs.filter(F.col("id") > middle), 1)
    before = index.statistics()[1]
    index.build()
    return index, before


_BOTH = f"{DOCS}, a AS ({sql_canonical('d', 'sig', X.alias_groups(EARLIER))}), b AS ({sql_canonical('d', 'sig', GROUPS)})"
_DF = "SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(canon)) AS term FROM {}) GROUP BY term"


@query(f"WITH {_BOTH} SELECT term, coalesce(x.df, 0) AS df_before, coalesce(y.df, 0) AS df_after FROM ({_DF.format('a')}) x FULL JOIN ({_DF.format('b')}) y USING (term)")
def alias_generation_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each term, by the earlier generation just before the swap and by the new one after it."""
    index, before = _index(spark, sf_dir)
    after = index.statistics()[1].withColumnRenamed("df", "df_after")
    both = before.withColumnRenamed("df", "df_before").join(after, "term", "full")
    return both.select("term", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("df_before", "df_after")])


_LAST = f"SELECT * FROM b ORDER BY doc_id DESC LIMIT {LIMIT}"


@query(f"WITH {_BOTH}, l AS ({_LAST}), s AS (SELECT count(*) AS n, round(avg(len(canon)), 6) AS avgdl FROM l) SELECT n, avgdl, term, df FROM ({_DF.format('l')}) CROSS JOIN s")
def alias_generation_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new generation's figures over the last LIMIT documents, which is how far back scores look."""
    totals, df = _index(spark, sf_dir)[0].statistics(LIMIT)
    return df.crossJoin(F.broadcast(totals)).select("n", F.round("avgdl", 6).alias("avgdl"), "term", "df")
