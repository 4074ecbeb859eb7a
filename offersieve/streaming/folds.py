"""Structured Streaming forms of the folds: the same steps as in batch, with their state kept by the engine.

A micro-batch is put in order of arrival time within each key; rows later than the watermark are dropped by the engine.
State that outlives its window leaves by timeout.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from offersieve.operators.relevance import near_duplicate_step
from offersieve.operators.service import admitted_step

_KEPT = "at array<double>, url array<string>, price array<decimal(18,2)>, models array<array<string>>, product array<array<string>>, strong array<boolean>"
_FIELDS = ["at", "url", "price", "models", "product", "strong"]


def first_seen(offers: DataFrame, native: list[str], at: str, delay: str = "30 days") -> DataFrame:
    """The first row of each native id within the delay."""
    return offers.withWatermark(at, delay).dropDuplicatesWithinWatermark(native)


def near_duplicates(material: DataFrame, user: str, at: str, window: float = 600.0, delay: str = "1 minute") -> DataFrame:
    """user_id, seq, reason of every arrival; a user's state is the fingerprints of its last window."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = [dict(zip(_FIELDS, r, strict=True)) for r in zip(*state.get, strict=True)] if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["when", "seq"])
        said = []
        for r in rows.itertuples(index=False):
            price = None if r.stated is None or r.stated != r.stated else r.stated
            row = {"at": r.when, "url": r.canonical, "price": price, "models": list(r.models), "product": list(r.product), "strong": bool(r.strong)}
            reason, kept = near_duplicate_step(kept, row, window)
            said.append(reason)
        state.update(tuple([k[f] for k in kept] for f in _FIELDS))
        if kept:
            state.setTimeoutTimestamp(max(int((max(k["at"] for k in kept) + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "seq": rows.seq, "reason": said})

    cols = material.withWatermark(at, delay).select(F.col(user).cast("long").alias("user"), "seq", at, (F.unix_micros(F.col(at)) / 1e6).alias("when"), "canonical", "stated", "models", "product", "strong")
    return cols.groupBy("user").applyInPandasWithState(run, "user_id long, seq long, reason string", _KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def admitted(events: DataFrame, key: str, seq: str, at: str, limits: tuple[tuple[float, int], ...], delay: str = "1 minute") -> DataFrame:
    """key, seq, admitted of a sliding-window limiter; the state is the admissions of the longest window."""
    longest = max(w for w, _ in limits)

    def run(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log: list[Any] = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["when", "seq"])
        said = []
        for t in rows["when"]:
            ok, log = admitted_step(log, t, limits)
            said.append(ok)
        state.update((log,))
        if log:
            state.setTimeoutTimestamp(max(int((max(log) + longest) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": of[0], "seq": rows.seq, "admitted": said})

    cols = events.withWatermark(at, delay).select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), at, (F.unix_micros(F.col(at)) / 1e6).alias("when"))
    return cols.groupBy("key").applyInPandasWithState(run, "key long, seq long, admitted boolean", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def hourly(events: DataFrame, at: str, key: str, value: str, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by hour and key, emitted once the watermark passes the hour."""
    return events.withWatermark(at, delay).groupBy(F.window(at, "1 hour").alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("w.start", key, "n", "total")
