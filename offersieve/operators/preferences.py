"""Preferences as data: validation, the fold of revisions, snapshots, and the check of risky changes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of a change and of a state.
MAX_OPERATIONS, MAX_ENTRIES, MAX_BYTES = 25, 500, 131_072
RULE_ID = r"^[A-Za-z0-9_.:-]+$"


def entry_problem(kind: Column, data: Column) -> Column:
    """The first thing wrong with an entry's JSON object, or null."""
    get = lambda *ks: F.coalesce(*[F.get_json_object(data, f"$.{k}") for k in ks])
    num = lambda *ks: get(*ks).try_cast("decimal(30,10)")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    items = lambda *ks: F.from_json(get(*ks), "array<string>")
    empty = lambda c: F.coalesce(F.size(F.filter(c, lambda x: F.trim(x) != "")) == 0, F.lit(True))
    whole = lambda c: c.isNotNull() & (c == F.floor(c))
    importance = F.coalesce(num("importance"), F.when(get("importance").isNull(), F.lit(50).cast("decimal(30,10)")))
    low, high = num("constraints.min_price", "constraints.minimum_price"), num("constraints.max_price", "constraints.maximum_price")
    interest = (
        F.when(blank(get("name", "product", "category")), "name")
        .when(~whole(importance) | ~importance.between(0, 100), "importance")
        .when(~low.between(0, 10**9) | ~high.between(0, 10**9), "price_bound")
        .when(low > high, "price_order")
    )
    canonical = F.lower(F.trim(get("canonical")))
    others = F.filter(items("synonyms", "aliases"), lambda x: F.lower(F.trim(x)) != canonical)
    rule = (
        F.when(~F.coalesce(get("rule_id", "id").rlike(RULE_ID) & (F.length(get("rule_id", "id")) <= 100), F.lit(False)), "rule_id")
        .when(~F.coalesce(whole(num("priority")) & num("priority").between(-(10**6), 10**6), F.lit(False)), "priority")
        .when(~F.coalesce(F.lower(get("action")).isin("allow", "deny"), F.lit(False)), "action")
        .when(empty(items("any")) & empty(F.from_json(get("all"), "array<string>")), "matcher")
    )
    return (
        F.when(kind == "interest", interest)
        .when(kind == "exclusion", F.when(empty(items("terms")) & blank(get("term")), "terms"))
        .when(kind.isin("context", "baseline_note"), F.when(blank(get("text", "fact", "profile")), "text"))
        .when(kind == "alias", F.when(blank(canonical), "canonical").when(empty(others), "synonyms"))
        .when(kind == "hard_rule", rule)
        .otherwise("kind")
    )


def risk(ops: DataFrame, current: DataFrame, change: str = "change_id") -> DataFrame:
    """change, needs_confirmation, reason. ops: change, action, kind, entry_id; current: entry_id, entry_kind,
    has_category. Features are sums, so a change of any size is one row before the shuffle."""
    j = ops.join(current, "entry_id", "left")
    gone = F.col("action") == "remove"
    f = j.groupBy(change).agg(
        F.count("*").alias("n"),
        F.count_if((F.col("kind") == "hard_rule") | (F.col("entry_kind") == "hard_rule")).alias("rules"),
        F.count_if(gone).alias("removed"),
        F.count_if(gone & (F.col("entry_kind") == "interest") & F.col("has_category")).alias("categories"),
    )
    reason = F.when(F.col("rules") > 0, "hard_rule_change").when(F.col("n") > 5, "more_than_five_entries").when(F.col("categories") > 0, "category_deletion").when(F.col("removed") > 1, "bulk_deletion").otherwise("narrow_change")
    return f.select(change, (reason != "narrow_change").alias("needs_confirmation"), reason.alias("reason"))


def overlay(old: dict, new: dict) -> dict:
    """new over old; objects that stand on both sides are laid over one another in turn."""
    return old | {k: overlay(old[k], v) if isinstance(v, dict) and isinstance(old.get(k), dict) else v for k, v in new.items()}


def change_step(state: dict[str, dict], revision: int, base: int, operations: list[dict]) -> tuple[dict[str, dict], str]:
    """One change against the current entries: (entries after it, `applied`), or (the same ones, why not). All of a change
    applies or none of it."""
    if base != revision:
        return state, "stale"
    if not 0 < len(operations) <= MAX_OPERATIONS:
        return state, "operations"
    new = dict(state)
    for op in operations:
        name, there = op["entry_id"], op["entry_id"] in new
        if (op["action"] == "add") == there:
            return state, "exists" if there else "missing"
        if op["action"] == "remove":
            del new[name]
        else:
            new[name] = overlay(new[name], op["data"]) if op["action"] == "update" else op["data"]
    if len(new) > MAX_ENTRIES or len(json.dumps(new).encode()) > MAX_BYTES:
        return state, "size"
    return new, "applied"


def folded(changes: DataFrame) -> DataFrame:
    """user_id, seq, outcome, revision, entries (JSON) for a log of user_id, seq, base_revision, operations (JSON list of
    action, entry_id, data). Rows come sorted by user, so a task holds one user's current entries, which are bounded."""
    import pyarrow as pa

    def fold(batches):
        mine, state, revision = None, {}, 0
        for b in batches:
            out: list[list] = [[], [], []]
            for u, base, ops in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if u != mine:
                    mine, state, revision = u, {}, 0
                state, said = change_step(state, revision, base, json.loads(ops))
                revision += said == "applied"
                for c, v in zip(out, (said, revision, json.dumps(state, sort_keys=True)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["user_id", "seq", "outcome", "revision", "entries"])

    rows = changes.select(F.col("user_id").cast("long"), F.col("seq").cast("long"), F.col("base_revision").cast("long"), F.coalesce("operations", F.lit("[]")).alias("operations"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "seq").mapInArrow(fold, "user_id long, seq long, outcome string, revision long, entries string")


def restored(history: DataFrame, user: str, revision: str, target: str, entries: str) -> DataFrame:
    """user and the entries of its `target` revision under the number after its last one."""
    last = history.groupBy(user).agg(F.max(revision).alias("last"))
    old = history.filter(F.col(revision) == F.col(target)).select(user, entries, F.col(revision).alias("restored_from"))
    return old.join(last, user).select(user, (F.col("last") + 1).alias(revision), "restored_from", entries)


def snapshot(entries: DataFrame, user: str = "user_id") -> DataFrame:
    """user, and per kind its entries sorted by id; `clash` if two rules share an id or a priority. A user has at most
    MAX_ENTRIES entries, so the lists are bounded."""
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("entry_id", "data")))).alias(k)
    rule = lambda f: F.when(F.col("kind") == "hard_rule", F.get_json_object("data", f"$.{f}"))
    n = F.count_if(F.col("kind") == "hard_rule")
    clash = (F.count_distinct(rule("rule_id")) < n) | (F.count_distinct(rule("priority")) < n)
    return entries.groupBy(user).agg(*[of(k) for k in ("alias", "context", "exclusion", "hard_rule", "interest")], clash.alias("clash"))
