"""Settings from YAML, on the driver. A value that is a whole `${NAME:-default}` takes the environment's, as YAML."""

from __future__ import annotations

import os
import re
from typing import Any

_HOLE = re.compile(r"\$\{([A-Za-z_]\w*)(?::-(.*))?\}")
# The ranges that numbers must keep to.
RANGES = {"pipeline.bm25_below_threshold_audit_rate": (0, 1), "pipeline.bm25_b": (0, 1), "pipeline.bm25_k1": (0, 10), "state.retention_days": (1, 3650), "state.corpus_limit": (1, 10_000_000)}


class SettingsError(ValueError):
    pass


def load(path: str) -> dict[str, Any]:
    import yaml

    def fill(x: Any) -> Any:
        if isinstance(x, dict | list):
            return {k: fill(v) for k, v in x.items()} if isinstance(x, dict) else [fill(v) for v in x]
        hole = _HOLE.fullmatch(x) if isinstance(x, str) else None
        if hole is None:
            return x
        raw = os.environ.get(hole[1]) or hole[2]
        if raw is None:
            raise SettingsError(f"{hole[1]} is not set")
        typed = hole[2] is None or (hole[2] != "" and not isinstance(yaml.safe_load(hole[2]), str))
        return yaml.safe_load(raw) if typed else raw

    with open(path, encoding="utf-8") as f:
        out = fill(yaml.safe_load(f) or {})
    if not isinstance(out, dict):
        raise SettingsError("settings are not a mapping")
    for name, (low, high) in RANGES.items():
        part: Any = out
        for key in name.split("."):
            part = part.get(key) if isinstance(part, dict) else None
        if part is not None and not (isinstance(part, int | float) and low <= part <= high):
            raise SettingsError(f"{name} is not within {low} and {high}")
    return out
