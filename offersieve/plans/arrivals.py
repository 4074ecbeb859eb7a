"""Scores as of arrival: every document against the corpus of the last LIMIT documents, itself included, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.functions import text as X
from offersieve.operators import arrivals as A
from offersieve.operators.lineage import written
from offersieve.plans.offers import _ROLL, CANON, PROFILE, _canon, _q, _read, _sig

QUERIES: dict = {}
ORACLE: dict = {}

LIMIT = 400
#: A user's terms: where in the significant tokens of the user's document they begin, how many, and their importance.
TERMS = ((5, 2, 80), (20, 1, 30))
_FRAME = f"{LIMIT - 1} PRECEDING AND CURRENT ROW"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def sql_scores(tokens: str) -> str:
    """k: user_id, seq, score from r (seq, len, tokens) and u (user_id, term, weight)."""
    return f"""st AS (SELECT seq, len, count(*) OVER w AS n, (avg(len) OVER w)::DOUBLE AS avgdl FROM r WINDOW w AS (ORDER BY seq ROWS BETWEEN {_FRAME})),
    asked AS (SELECT DISTINCT term FROM u), p AS (SELECT seq, term, count(*)::DOUBLE AS tf FROM (SELECT seq, unnest({tokens}) AS term FROM r) JOIN asked USING (term) GROUP BY seq, term),
    f AS (SELECT *, count(*) OVER (PARTITION BY term ORDER BY seq RANGE BETWEEN {_FRAME}) AS df FROM p),
    k AS (SELECT user_id, seq, sum(weight * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / greatest(avgdl, 1.0::DOUBLE)))) AS score FROM f JOIN st USING (seq) JOIN u USING (term) GROUP BY user_id, seq)"""


_PROFILE = "u AS (SELECT * FROM (VALUES " + ", ".join(f"(0, {_q(t)}, {w}::DOUBLE)" for t, w in PROFILE.items()) + ") AS v(user_id, term, weight))"


@query(f"WITH {CANON}, r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq, doc_id, len(canon) AS len, canon FROM c), {_PROFILE}, {sql_scores('canon')} SELECT doc_id, n, round(avgdl, 6) AS avgdl, round(coalesce(score, 0), 6) AS score FROM r JOIN st USING (seq) LEFT JOIN k USING (seq)")
def scores_as_of_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile's score of every document, with the size and mean length of the corpus at its arrival."""
    terms = spark.createDataFrame([(0, t, w) for t, w in PROFILE.items()], "user_id long, term string, weight double")
    docs, posted = A.postings(_canon(spark, sf_dir), "doc_id", "canon", terms)
    found, stats = A.scores(docs, posted, terms, LIMIT), A.rolling_stats(docs, LIMIT)
    return docs.select("doc_id", "seq").join(stats, "seq").join(found, "seq", "left").select("doc_id", "n", F.round("avgdl", 6).alias("avgdl"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


_TAKEN = " UNION ALL ".join(f"SELECT s_suppkey::BIGINT, unnest(sig[{a}:{a + n - 1}]), {0.5 + w / 100}::DOUBLE FROM supplier JOIN d ON doc_id = s_suppkey * 2" for a, n, w in TERMS)


@query(f"WITH {_ROLL}, u0(user_id, term, weight) AS ({_TAKEN}), u AS (SELECT user_id, term, max(weight) AS weight FROM u0 GROUP BY user_id, term), {sql_scores('sig')}, o AS (SELECT doc_id, user_id, score FROM k JOIN r USING (seq)) SELECT doc_id, count(*) AS n_users, arg_max(user_id, (round(score, 6), -user_id)) AS best_user, round(max(score), 6) AS best_score, round(sum(score), 4) AS total FROM o GROUP BY doc_id")
def arrivals_best_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as users, each with weighted terms taken from a document. For every document in which a user's term stands:
    how many users it concerns, which one most as of its arrival (ties to the smaller id), and the sum of all scores."""
    asked = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("doc_id"), F.col("s_suppkey").cast("long").alias("user_id"))
    # only texts that users take terms from are normalised for them
    of = _read(spark, sf_dir, "documents").select("doc_id", "text").join(asked, "doc_id").withColumn("sig", X.significant_of(X.normalize(F.col("text"))))
    weighted = lambda weight: lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight"))
    taken = F.flatten(F.array(*[F.transform(F.slice("sig", a, n), weighted(0.5 + w / 100)) for a, n, w in TERMS]))
    terms = written(of.select("user_id", F.inline(taken)))
    return A.best_users(_sig(spark, sf_dir), "doc_id", "sig", terms, LIMIT)
