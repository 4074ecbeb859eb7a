"""Admission of requests to a metered provider: a daily budget, a budget per stage, a rate, and circuits that stay open
once one of them is spent. The state is one small record a project, so the same step serves batch and stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBE_SECONDS = 120.0
MINUTE = 60.0


@dataclass(frozen=True)
class Caps:
    daily: int = 400
    per_minute: int = 5
    stages: dict = field(default_factory=lambda: {"evaluation": 350, "preference": 25})


@dataclass
class Ledger:
    """Counts of the current day, admissions of the last minute, and open circuits: scope to (until, reason)."""

    day: str = ""
    used: dict = field(default_factory=dict)
    recent: list = field(default_factory=list)
    circuits: dict = field(default_factory=dict)
    probe_at: float | None = None


def admission_step(s: Ledger, at: float, day: str, resets: float, stage: str, caps: Caps) -> str:
    """`admitted`, `probe` (admitted to test a circuit that has run out), or what denied the request. Changes s."""
    if day != s.day:
        s.day, s.used = day, {}
    for scope in ("daily", stage):
        if scope in s.circuits:
            if s.circuits[scope][0] > at:
                return f"{scope}_circuit"
            del s.circuits[scope]
    probing = False
    if "temporary" in s.circuits:
        if s.circuits["temporary"][0] > at:
            return "temporary_circuit"
        if s.probe_at is not None and at - s.probe_at < PROBE_SECONDS:
            return "half_open_blocked"
        s.probe_at, probing = at, True
    stage_cap = caps.stages.get(stage)
    if sum(s.used.values()) >= caps.daily:
        s.circuits["daily"] = (resets, "daily_cap")
        return "daily_budget"
    if stage_cap is not None and s.used.get(stage, 0) >= stage_cap:
        s.circuits[stage] = (resets, f"{stage}_cap")
        return f"{stage}_budget"
    s.recent = [t for t in s.recent if t > at - MINUTE]
    if len(s.recent) >= caps.per_minute:
        s.circuits["temporary"], s.probe_at = (max(at + 0.001, s.recent[0] + MINUTE), "rate"), None
        return "rate_budget"
    s.recent.append(at)
    s.used[stage] = s.used.get(stage, 0) + 1
    return "probe" if probing else "admitted"


def outcome_step(s: Ledger, ok: bool) -> None:
    """A probe's outcome: success closes the temporary circuit."""
    if ok:
        s.circuits.pop("temporary", None)
        s.probe_at = None


def admissions(requests: DataFrame, key: str, order: str, at: str, stage: str, caps: Caps | None = None, zone: str = "America/Los_Angeles") -> DataFrame:
    """key, seq, verdict for requests in order of time; every admitted request is taken to succeed. Days are the zone's,
    so one may have 23 or 25 hours. A key's rows arrive sorted and in Arrow batches, so a task holds a batch, not a key."""
    import pyarrow as pa

    caps = caps or Caps()
    here = F.from_utc_timestamp(F.col(at), zone)
    resets = F.to_utc_timestamp(F.date_add(F.to_date(here), 1).cast("timestamp"), zone)
    micros = lambda c: F.unix_micros(c) / 1e6
    rows = requests.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("seq"), micros(F.col(at).cast("timestamp")).alias("at"), F.to_date(here).cast("string").alias("day"), micros(resets).alias("resets"), F.col(stage).alias("stage"))

    def fold(batches):
        mine, state = None, Ledger()
        for b in batches:
            keys, said = b.column(0).to_pylist(), []
            for k, t, d, r, g in zip(keys, *(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if k != mine:
                    mine, state = k, Ledger()
                said.append(admission_step(state, t, d, r, g, caps))
                if said[-1] == "probe":
                    outcome_step(state, True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string())], names=["key", "seq", "verdict"])

    return rows.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(fold, "key long, seq long, verdict string")
