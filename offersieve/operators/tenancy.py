"""Users, invitations, confirmations and queues: what is a lookup with a default, a predicate or a bounded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INVITATION_SECONDS, CONFIRMATION_SECONDS, RATE_EVENT_SECONDS = 86_400, 600, 3_600
#: Of the retry queue: most jobs, their life, the shortest delay.
RETRY_MOST, RETRY_SECONDS, RETRY_LEAST = 100, 3_600, 5.0
REASON_CHARS = 500


def with_flag(users: DataFrame, flags: DataFrame, user: str, flag: str) -> DataFrame:
    """users with a flag that is false where nothing is stored."""
    return users.join(flags.select(user, flag), user, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def idle(interests: Column, exceptional: Column) -> Column:
    """A user whose decisions are all idle: no interests, and exceptional offers off."""
    return (F.coalesce(interests, F.lit(0)) == 0) & ~F.coalesce(exceptional, F.lit(False))


def page_after(rows: DataFrame, key: str, cursor: int, size: int) -> DataFrame:
    """A keyset page: the first rows after the cursor."""
    return rows.filter(F.col(key) > cursor).orderBy(key).limit(size)


def listed(rows: DataFrame, wanted: dict[str, object], *order: str) -> DataFrame:
    """Rows that have all wanted values (None asks for nothing), in order; text is ordered without regard to case."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    text = {c for c, t in rows.dtypes if t == "string"}
    return rows.orderBy(*(F.lower(c) if c in text else F.col(c) for c in order))


def carried(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """rows whose column takes the one value stored for their key, or stays."""
    return rows.join(updates.select(key, F.col(column).alias("__new")), key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def redeemable(created: Column, used: Column, now: Column) -> Column:
    """An invitation that nobody has used and that is younger than its life."""
    return ~used & (created + F.expr(f"INTERVAL {INVITATION_SECONDS} SECONDS") > now)


def open_confirmations(asked: DataFrame, current: DataFrame, actor: str, base: str, at: str, now: Column) -> DataFrame:
    """Confirmations that have not expired and whose base is still the actor's current revision."""
    return asked.join(current.select(actor, F.col(base).alias("__current")), actor).filter((F.col(base) == F.col("__current")) & (F.col(at) + F.expr(f"INTERVAL {CONFIRMATION_SECONDS} SECONDS") > now)).drop("__current")


def transient_survivors(rows: DataFrame, at: str, now: Column) -> DataFrame:
    return rows.filter(F.col(at) > now - F.expr(f"INTERVAL {RATE_EVENT_SECONDS} SECONDS"))


def offsets(updates: DataFrame, stream: str, update_id: str) -> DataFrame:
    """For each stream, how many different updates there are, and the offset after the last."""
    return updates.groupBy(stream).agg(F.count_distinct(update_id).alias("n"), (F.max(update_id) + 1).alias("next_offset"))


def admitted_retries(asked: DataFrame, queued: DataFrame, keys: list[str], order: list[str], retry_after: str) -> DataFrame:
    """Requests that enter the retry queue: not queued yet, the first of their key, while there is room; with their delay.
    What is taken from all requests is the first RETRY_MOST of a global order, so no task sees more than that."""
    new = asked.join(queued.select(*keys), keys, "left_anti").withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__nth = 1").drop("__nth")
    room = max(0, RETRY_MOST - queued.limit(RETRY_MOST).count())
    delay = F.greatest(F.lit(RETRY_LEAST), F.least(F.lit(float(RETRY_SECONDS)), F.coalesce(F.col(retry_after).cast("double"), F.lit(RETRY_LEAST))))
    return new.orderBy(*order).limit(room).withColumn("delay", delay)


def decisions(judged: DataFrame, reason: str) -> DataFrame:
    """Verdicts as they are stored: reasons cut short."""
    return judged.withColumn(reason, F.substring(reason, 1, REASON_CHARS))
