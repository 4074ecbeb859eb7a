"""Reply states against a plain fold, and logs that take batches twice."""

import random

import pytest

from offersieve.operators import outbox as O

REPLIES = "reply_id long, user_id long, operation string, target long"
ATTEMPTS = "reply_id long, seq long, outcome string, error string"


def _fold(operation, target, tries):
    status, n, last = "open", 0, None
    for outcome, error in tries:
        if status != "open":
            break
        n += 1
        if outcome == "sent":
            status = "sent"
            continue
        last = error and error[: O.ERROR_CHARS]
        if outcome == "stale" and operation == "edit":
            operation, target = "send", None
        elif outcome in ("stale", "permanent") or n >= O.MOST_ATTEMPTS:
            status = "dropped"
    return operation, target, status, n, last


@pytest.mark.parametrize("seed", range(3))
def test_reply_state(spark, seed):
    r = random.Random(seed)
    kinds = ["retry"] * 12 + ["stale"] * 3 + ["sent", "permanent", None, "?"]
    replies = [(i, i % 7, *(("edit", i + 900) if r.random() < 0.6 else ("send", None))) for i in range(120)]
    tries = {i: [(r.choice(kinds), r.choice([None, "", "e" * 600, f"fault {k}"])) for k in range(r.randrange(0, 10))] for i in range(120)}
    rows = [(i, k, *t) for i, ts in tries.items() for k, t in enumerate(ts)] + [(999, 0, "sent", "no such reply")]
    r.shuffle(rows)
    got = O.reply_state(spark.createDataFrame(replies, REPLIES), spark.createDataFrame(rows, ATTEMPTS).repartition(4), ["seq"])
    assert {x.reply_id: tuple(x)[2:] for x in got.collect()} == {i: _fold(op, target, tries[i]) for i, _, op, target in replies}
    open_ = [x for x in replies if _fold(x[2], x[3], tries[x[0]])[2] == "open"]
    want = {(u, i, p) for u in range(7) for p, i in enumerate([x[0] for x in open_ if x[1] == u][:3], 1)}
    assert {(x.user_id, x.reply_id, x.place) for x in O.next_replies(got, 3).collect()} == want and want


def test_empty(spark):
    none = spark.createDataFrame([], ATTEMPTS)
    assert O.reply_state(spark.createDataFrame([], REPLIES), none, ["seq"]).count() == 0
    assert [tuple(x) for x in O.reply_state(spark.createDataFrame([(1, 2, "edit", 3)], REPLIES), none, ["seq"]).collect()] == [(1, 2, "edit", 3, "open", 0, None)]


def test_log_takes_batches_twice(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long, more string")
    log = O.BatchLog(spark, f"file://{tmp_path}", spark.createDataFrame([], "k string, v long").schema)
    first = rows(("a", 2, "x"), ("a", 1, "x"), (None, 5, "x"), ("b", 9, None))
    log.append(first, 0)
    log.append(rows(("a", 0, "x"), ("c", 3, "x"), (None, 4, "x")), 1)
    want = {("a", 1, 0), (None, 5, 0), ("b", 9, 0), ("c", 3, 1)}
    said = lambda: [tuple(r) for r in log.rows(["k"], ["v"]).collect()]
    assert set(said()) == want and len(said()) == 4
    log.append(first, 0)
    log.append(rows(("a", 0, "x"), ("c", 3, "x"), (None, 4, "x")), 1)
    assert set(said()) == want and len(said()) == 4


def test_log_as_a_sink(spark, tmp_path):
    """A stream that loses its checkpoint and starts again writes nothing anew."""
    for i in range(3):
        spark.createDataFrame([(10 * i + j, j) for j in range(5)], "k long, v long").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    log = O.BatchLog(spark, f"file://{tmp_path}/log", spark.createDataFrame([], "k long, v long").schema)
    for checkpoint in ("c1", "c2"):
        stream = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        run = stream.writeStream.foreachBatch(log.append).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        assert run.awaitTermination(120)
        assert sorted(r.k for r in log.rows(["k"], ["v"]).collect()) == [10 * i + j for i in range(3) for j in range(5)]


def test_attempts_of_a_reply_are_one_row_without_another_sort(spark):
    """the window that numbers attempts gives them as one row; more than can count are left out."""
    replies = spark.createDataFrame([(1, 1, "send", None), (2, 1, "edit", 9), (3, 1, "send", None)], REPLIES)
    attempts = spark.createDataFrame([(1, i, "retry", f"e{i}") for i in range(20)] + [(2, 0, "stale", "s"), (2, 1, None, None)], ATTEMPTS)
    state = O.reply_state(replies, attempts, ["seq"])
    assert "collect_list" not in state._jdf.queryExecution().optimizedPlan().toString()
    got = {r.reply_id: (r.operation, r.status, r.attempts, r.last_error) for r in state.collect()}
    assert got == {1: ("send", "dropped", 5, "e4"), 2: ("send", "open", 2, None), 3: ("send", "open", 0, None)}
