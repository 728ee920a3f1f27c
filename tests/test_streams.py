"""Streams of several batches, with late rows and restarts, against the same rows as one table."""

import datetime
import random

import pytest

from fernweave.streaming import events, locks, runs

DAY = datetime.datetime(2024, 5, 1)
EVENTS = "event_id long, user_id long, ts timestamp, event_type string"


def attempts(n=240, seed=5):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([1, 1, 5, 20, 61])
        rows.append((i, rng.randint(1, 3), DAY + datetime.timedelta(seconds=at), rng.choice(["error"] * 8 + ["signup", "view"])))
    return rows


@pytest.fixture
def session(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    locks.use_state(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def write(spark, rows, folder, k):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/in/{k}")


def expected(spark, rows, last):
    """Outcomes of all that is at least ten minutes older than the last attempt."""
    of = {r.event_id: (r.user_id, r.outcome) for r in events.locked_out(spark.createDataFrame(rows, EVENTS)).collect()}
    kinds = ("error", "signup")
    return sorted((of[i][0], i, of[i][1]) for i, _, ts, kind in rows if kind in kinds and ts <= last - datetime.timedelta(minutes=10))


def test_lock_on_a_stream_with_late_attempts_and_a_restart(session, tmp_path):
    rows = attempts()
    shuffled = [rows[k] for k in sorted(range(len(rows)), key=lambda k: k + random.Random(k).randint(0, 25))]  # late by minutes at most
    cuts = [0, 60, 61, 130, 240]
    folder = f"file://{tmp_path}"
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        write(session, shuffled[a:b], folder, k)
        stream = runs.file_stream(session, f"{folder}/in/*", EVENTS, files_each=1)
        got = runs.run_now(locks.locked_stream(stream), folder)  # each run starts anew from the checkpoint
    last = max(r[2] for r in rows if r[3] in ("error", "signup"))
    want = expected(session, rows, last)
    assert sorted(map(tuple, got.collect())) == want and len({o for _, _, o in want}) == 4


def test_attempts_behind_the_watermark_are_refused(session, tmp_path):
    folder = f"file://{tmp_path}"
    early = [(1, 1, DAY, "error"), (2, 1, DAY + datetime.timedelta(hours=2), "error")]
    write(session, early, folder, 0)
    runs.run_now(locks.locked_stream(runs.file_stream(session, f"{folder}/in/*", EVENTS)), folder)
    write(session, [(3, 1, DAY + datetime.timedelta(seconds=5), "signup"), (4, 1, DAY + datetime.timedelta(hours=5), "view"), (5, 2, DAY + datetime.timedelta(hours=5), "error"), (6, None, DAY, "error")], folder, 1)
    got = runs.run_now(locks.locked_stream(runs.file_stream(session, f"{folder}/in/*", EVENTS)), folder)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "failed"), (1, 2, "failed")]


def test_the_count_outlasts_the_lock():
    state, told = (0, None), []
    for at, ok in [(0, False), (1, False), (2, False), (3, True), (4, False), (5, True)] + [(10 + k, False) for k in range(5)] + [(20, True), (80_000_000, False), (80_000_001, True), (150_000_000, True)]:
        outcome, *state = locks.judge(ok, at, *state, 5, 60_000_000)
        told.append(outcome)
    assert told == ["failed"] * 3 + ["ok", "failed", "ok"] + ["failed"] * 4 + ["locked", "rejected", "locked", "rejected", "ok"]


def test_attempts_of_a_share_that_came_together_are_one_row_of_state(session, tmp_path):
    folder, users = f"file://{tmp_path}", 20
    rows = [(i, i % users, DAY + datetime.timedelta(seconds=i), "signup" if i % 7 == 0 else "error") for i in range(4000)]
    write(session, rows, folder, 0)
    query = locks.locked_stream(runs.file_stream(session, f"{folder}/in/*", EVENTS)).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    written = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress]
    assert written and max(written) <= 2 * users  # what waits of a share and the accounts of its users, not the attempts
    assert sorted(map(tuple, session.read.parquet(f"{folder}/rows").collect())) == expected(session, rows, rows[-1][2])


def test_users_of_one_share_are_judged_apart(session, tmp_path):
    folder, rows = f"file://{tmp_path}", attempts(seed=9)
    for k, (a, b) in enumerate(((0, 150), (150, 240))):
        write(session, rows[a:b], folder, k)
        got = runs.run_now(locks.locked_stream(runs.file_stream(session, f"{folder}/in/*", EVENTS, files_each=1), shares=1), folder)
    assert sorted(map(tuple, got.collect())) == expected(session, rows, max(r[2] for r in rows if r[3] in ("error", "signup")))


def test_attempts_without_an_id_come_last_of_their_time(session, tmp_path):
    folder, far = f"file://{tmp_path}", 2**60 + 1
    rows = [(None, 1, DAY, "signup"), (far, 1, DAY, "error"), (None, 2, DAY, "error"), (7, 1, DAY + datetime.timedelta(hours=1), "view"), (8, 3, DAY + datetime.timedelta(hours=1), "error")]
    write(session, rows, folder, 0)
    got = runs.run_now(locks.locked_stream(runs.file_stream(session, f"{folder}/in/*", EVENTS)), folder)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, far, "failed"), (1, None, "ok"), (2, None, "failed")]))
