"""The login lock on a stream: keyed state with event-time timers, so that late attempts are counted in their place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from fernweave.streaming.events import timed

OUTCOMES = "user_id long, event_id long, outcome string"
#: An attempt that waits; ``unnamed``: it has no event_id.
ATTEMPT = np.dtype([("user_id", "<i8"), ("at", "<i8"), ("event_id", "<i8"), ("unnamed", "?"), ("ok", "?")])
MOST_ROWS = 10_000  # attempts in one value of the state


def judge(ok: bool, at: int, failures: int, until: int | None, most: int, length: int) -> tuple[str, int, int | None]:
    """Outcome of one attempt, and the failures and the end of the lock after it; times in microseconds."""
    if until is not None and at < until:
        return "rejected", failures, until
    if ok:
        return "ok", 0, None
    failures += 1
    return ("locked", failures, at + length) if failures >= most else ("failed", failures, None)


class LoginLock(StatefulProcessor):
    """State of a share of the users: the count and the lock of each, and the attempts that the watermark has not passed.

    An attempt waits until no earlier one can come any more; a timer at the earliest waiting one wakes the share. A user who has
    no failures and nothing waiting has no state. What came together waits as one value, so that the calls for the state
    are some for each share and at most two for each user who is due, not one for each attempt.
    """

    def __init__(self, most: int, seconds: int):
        self._most, self._length = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._accounts = handle.getMapState("accounts", "user_id long", "failures int, until long")
        self._waiting = handle.getListState("waiting", "attempts binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for batch in rows:
            came = np.empty(len(batch), ATTEMPT)
            for name in ATTEMPT.names:
                came[name] = batch[name]
            self._waiting.appendValue((came.tobytes(),))
            earliest.append(came["at"].min())
        if earliest:
            self._wake(min(earliest))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = np.concatenate([np.empty(0, ATTEMPT), *(np.frombuffer(r[0], ATTEMPT) for r in self._waiting.get())])
        passed = waiting["at"] <= timerValues.getCurrentWatermarkInMs() * 1000
        due, left = waiting[passed], waiting[~passed]
        if not len(due):
            return
        due = due[np.lexsort((due["event_id"], due["unnamed"], due["at"], due["user_id"]))]
        starts = np.flatnonzero(np.diff(due["user_id"], prepend=due["user_id"][0] - 1))
        outcomes: list[str] = []
        for a, b in zip(starts, [*starts[1:], len(due)], strict=True):
            outcomes += self._judged(int(due["user_id"][a]), due["at"][a:b].tolist(), due["ok"][a:b].tolist())
        if len(left):
            self._waiting.put([(left[k : k + MOST_ROWS].tobytes(),) for k in range(0, len(left), MOST_ROWS)])
            self._wake(left["at"].min())
        else:
            self._waiting.clear()
        events = pd.Series(due["event_id"], dtype="Int64").mask(due["unnamed"])
        yield pd.DataFrame({"user_id": due["user_id"], "event_id": events, "outcome": outcomes})

    def close(self) -> None:
        pass

    def _judged(self, user: int, times: list[int], oks: list[bool]) -> list[str]:
        """Outcomes of one user's attempts in their order; the account is kept as it is after them."""
        known = self._accounts.getValue((user,))
        failures, until = known or (0, None)
        outcomes = []
        for at, ok in zip(times, oks, strict=True):
            outcome, failures, until = judge(ok, at, failures, until, self._most, self._length)
            outcomes.append(outcome)
        if failures:
            self._accounts.updateValue((user,), (failures, until))
        elif known:
            self._accounts.removeKey((user,))
        return outcomes

    def _wake(self, earliest: int) -> None:
        """A timer that is due once the watermark has reached the earliest attempt."""
        self._handle.registerTimer(int(earliest) // 1000 - 1)


def use_state(spark: SparkSession) -> None:
    """Keep keyed state on disk, with changes written to the checkpoint: what the lock's state asks of the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def locked_stream(events: DataFrame, late: str = "10 minutes", most: int = 5, seconds: int = 60, shares: int = 4096) -> DataFrame:
    """(user_id, event_id, outcome) of a stream of events, as ``locked_out`` gives them for a table.

    An outcome is given once the watermark, ``late`` behind the latest attempt, has passed it; attempts that come later than
    that are refused by it. Attempts of one time are ordered by event_id, those without one last; rows without a user or a
    time give none. What waits is what came within ``late``, and a user's state is a few numbers, for any number of attempts.

    The state is keyed by shares of the users, dealt by a hash: a key has a cost of its own in every batch, which users with few
    attempts would pay each. ``shares`` must stay the same for all runs of a checkpoint.
    """
    attempts = timed(events, late).where(F.col("event_type").isin("error", "signup") & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    user, event = (F.col(c).cast("long") for c in ("user_id", "event_id"))
    columns = {"share": F.pmod(F.xxhash64(user), F.lit(shares)).cast("int"), "user_id": user, "at": F.unix_micros("ts"), "event_id": F.coalesce(event, F.lit(0)), "unnamed": event.isNull(), "ok": F.col("event_type") == "signup"}
    own = attempts.select(*(c.alias(name) for name, c in columns.items()), "ts")
    return own.groupBy("share").transformWithStateInPandas(LoginLock(most, seconds), OUTCOMES, "Append", "EventTime")
