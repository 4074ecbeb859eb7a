"""Operators of the service around the cascade: revisions of preferences, queues, budgets, health, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(log: DataFrame, key: str, revision: str, *columns: str) -> DataFrame:
    """The newest revision per key: one running maximum a key and task before the shuffle."""
    return log.groupBy(key).agg(F.max(revision).alias(revision), *[F.max_by(c, revision).alias(c) for c in columns])


def as_of_midnight(log: DataFrame, key: str, revision: str, at: str, now: Column, zone: str) -> DataFrame:
    """The newest revision before local midnight of `now`."""
    midnight = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now, zone)), zone)
    return log.filter(F.col(at) < midnight).groupBy(key).agg(F.max(F.struct(at, revision)).alias("m")).select(key, F.col(f"m.{revision}").alias(revision))


def history(log: DataFrame, key: str, revision: str, limit: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(revision))
    return log.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= limit)


def backoff(attempts: Column, base: int = 5, most: int = 300, power: int = 6) -> Column:
    return F.least(F.lit(most), (base * F.pow(F.lit(2), F.least(attempts, F.lit(power)))).cast("int"))


def failure_runs(events: DataFrame, name: str, ok: Column, order: str) -> DataFrame:
    """name, order, run: failures in a row up to and with each event; a success resets."""
    w = Window.partitionBy(name).orderBy(order)
    isles = events.select(name, order, ok.alias("ok")).withColumn("isle", F.sum(F.col("ok").cast("int")).over(w))
    return isles.select(name, order, F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy(name, "isle").orderBy(order)).alias("run"))


def admitted_step(log: list[float], at: float, limits: tuple[tuple[float, int], ...]) -> tuple[bool, list[float]]:
    """One request against a sliding-window limiter: only admitted requests count, and those at the edge have expired."""
    log = [t for t in log if t > at - max(w for w, _ in limits)]
    ok = all(sum(t > at - w for t in log) < n for w, n in limits)
    return ok, [*log, at] if ok else log


def admitted(events: DataFrame, key: str, order: str, at: str, limits: tuple[tuple[float, int], ...]) -> DataFrame:
    """key, order, admitted, as a fold in order of time that holds one window's admissions."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, log, out = pdf.sort_values(["at", "seq"]), [], []
        for t in pdf["at"]:
            ok, log = admitted_step(log, t, limits)
            out.append(ok)
        return pd.DataFrame({"key": pdf.key, "seq": pdf.seq, "admitted": out})

    rows = events.select(F.col(key).alias("key"), F.col(order).alias("seq"), F.col(at).cast("double").alias("at"))
    return rows.groupBy("key").applyInPandas(run, "key long, seq long, admitted boolean")


def pacific_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "America/Los_Angeles"))


def survivors(log: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """The newest `cap` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= cap).drop("no")


def clamped(delay: Column, least: int = 5, most: int = 300) -> Column:
    """A provider's own delay within bounds."""
    return F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), delay.cast("double")))


def enqueued(offers: DataFrame, active: DataFrame, done: DataFrame, user: str, key: list[str]) -> DataFrame:
    """What enters the delivery queue: offers to active users whose key was neither delivered nor queued, once each."""
    return offers.join(active, user, "left_semi").join(done, key, "left_anti").dropDuplicates(key)


def after_delivery(queue: DataFrame, outcomes: DataFrame, key: str = "id", now: Column | None = None) -> DataFrame:
    """The queue after a drain: sent rows leave for the deliveries, permanent failures stay as failed, and all others are
    tried again later, so that delivery is at least once. queue: key, attempts, status, next_attempt; outcomes: key,
    outcome (sent, permanent or other), retry_after."""
    now = F.current_timestamp() if now is None else now
    j = queue.join(outcomes, key, "left")
    again = F.coalesce(clamped(F.col("retry_after")), backoff(F.col("attempts") + 1, power=60).cast("double"))
    tried = F.col("outcome").isNotNull()
    status = F.when(~tried, F.col("status")).when(F.col("outcome") == "sent", "delivered").when(F.col("outcome") == "permanent", "failed").otherwise("pending")
    at = F.when(tried & ~F.col("outcome").isin("sent", "permanent"), F.timestamp_seconds(F.unix_micros(now) / 1e6 + again)).otherwise(F.col("next_attempt"))
    return j.select(key, (F.col("attempts") + tried.cast("int")).alias("attempts"), status.alias("status"), at.alias("next_attempt"))


def doomed(log: DataFrame, at: str, order: str, cutoff: Column, cap: int, batch: int = 500) -> DataFrame:
    """The rows that one retention pass deletes: the oldest `batch` past the cutoff, then the oldest `batch` of what lies
    beyond the newest `cap`. Both are top-k plans; no window holds the whole table."""
    old = log.filter(F.col(at) < cutoff).orderBy(order).limit(batch)
    left = log.join(old.select(order), order, "left_anti")
    spare = F.greatest(F.lit(0), left.agg(F.count("*")).scalar() - cap)
    over = left.orderBy(order).limit(batch).withColumn("no", F.row_number().over(Window.orderBy(order))).filter(F.col("no") <= spare).drop("no")
    return old.unionByName(over)
