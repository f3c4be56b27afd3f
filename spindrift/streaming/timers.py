"""Keyed state that changes without an input row: breakers that half-open, retries that fall due, keys that are forgotten.

State lives in the RocksDB store, one small entry a key; timers are the store's own. With event time a timer fires when
the watermark passes it, so replays give the same rows; with processing time it fires by the clock.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spindrift.streaming.events import CONSECUTIVE, LEAST_SAMPLES, MOST_ERRORS, RECOVERY_S, RETRY_S, REVIEW_S, WINDOW

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Failures that wait for a review at once.
REVIEW_KINDS, REVIEW_CODES = ("bad_target", "anti_bot"), (403, 404, 410, 422, 429)
#: What retries and breakers need of an outcome.
OUTCOME, VISIT = ["at", "seq", "failed", "kind", "code", "asked"], ["at", "seq", "failed"]


def _grouped(outcomes: DataFrame, key: str, columns: list[str]):
    """Rows by key, the key and the columns that the state needs in the first places."""
    rest = [c for c in outcomes.columns if c not in (key, *columns)]
    return outcomes.select(key, *columns, *rest).groupBy(key)


def _in_order(rows: Iterator[Row], n: int) -> list[tuple]:
    """One trigger's rows of a key by time and sequence: the n columns that the state needs."""
    return sorted((tuple(r[1 : n + 1]) for r in rows), key=lambda r: r[:2])


def review(kind: str | None, code: int | None) -> bool:
    return kind in REVIEW_KINDS or code in REVIEW_CODES


def retry_step(held: tuple[int, int, bool] | None, at: int, kind: str | None, code: int | None, asked: float | None) -> tuple[int, int, bool]:
    """(attempt, due in milliseconds, waiting) after a failure: waits of 1, 6 and 24 hours, then a review after 7 days from which the count starts anew.

    Targets that need a review wait for it from the first failure; a server's own wait counts instead, up to a review's.
    """
    attempt = held[0] + 1 if held else 0
    if review(kind, code) or attempt >= len(RETRY_S):
        attempt, wait = 0, REVIEW_S
    else:
        wait = RETRY_S[attempt]
    if asked and asked > 0:
        wait = min(asked, REVIEW_S)
    return attempt, at + int(wait * 1000), True


class _Retries(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "attempt int, due long, waiting boolean")

    def handleInputRows(self, key, rows, timerValues):
        first = self.held.get()  # null without a value: each call is a message to the store
        first = held = tuple(first) if first else None
        before = held[1] if held and held[2] else None
        for at, _, failed, kind, code, asked in _in_order(rows, len(OUTCOME)):
            if held and held[2] and held[1] <= at:  # fell due before this row, whether or not its timer has run
                yield Row(target=key[0], due=held[1], attempt=held[0])
                held = (*held[:2], False)
            held = retry_step(held, at, kind, code, asked) if failed else None
        after = held[1] if held and held[2] else None
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        if held and held != first:
            self.held.update(held)
        elif first and not held:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.held.get()
        if held:
            attempt, due, waiting = held
            if waiting and due == expiredTimerInfo.getExpiryTimeInMs():
                self.held.update((attempt, due, False))
                yield Row(target=key[0], due=due, attempt=attempt)

    def close(self) -> None:
        pass


def retries(outcomes: DataFrame, mode: str = "EventTime") -> DataFrame:
    """(target, due in milliseconds, attempt): each retry when it falls due, once; a success or a newer failure takes it back.

    outcomes: target, at (milliseconds), seq, failed, kind, code, asked (seconds a server asked for); with event time
    also a watermark on a column of its own.
    """
    return _grouped(outcomes, "target", OUTCOME).transformWithState(_Retries(), "target string, due long, attempt int", "Append", mode)


class _Breakers(StatefulProcessor):
    """status, opened and streak as a value, the last outcomes as a list."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, opened long, streak int")
        self.last = handle.getListState("last", "failed int")

    def _row(self, key: tuple, at: int, status: str, streak: int) -> Row:
        return Row(platform=key[0], at=at, status=status, streak=streak)

    def handleInputRows(self, key, rows, timerValues):
        status, opened, streak = self.state.get() or ("closed", 0, 0)
        before = opened if status == "open" else None
        last = [x[0] for x in self.last.get()]
        for at, _, failed in _in_order(rows, len(VISIT)):
            if status == "open" and at >= opened + RECOVERY_S * 1000:
                status = "half_open"
                yield self._row(key, opened + RECOVERY_S * 1000, status, streak)
            if status == "open":
                continue  # nothing is tried while open; what still comes in was under way
            if status == "half_open":
                status, opened, last, streak = ("open", at, [], streak) if failed else ("closed", 0, [], 0)
                yield self._row(key, at, status, streak)
                continue
            streak, last = streak + 1 if failed else 0, [*last, int(failed)][-WINDOW:]
            if streak >= CONSECUTIVE or len(last) >= LEAST_SAMPLES and sum(last) / len(last) >= MOST_ERRORS:
                status, opened = "open", at
                yield self._row(key, at, status, streak)
        after = opened if status == "open" else None
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before + RECOVERY_S * 1000)
            if after is not None:
                self.handle.registerTimer(after + RECOVERY_S * 1000)
        self.state.update((status, opened, streak))
        if last:
            self.last.put([(x,) for x in last])
        else:
            self.last.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status, opened, streak = self.state.get()
        if status == "open" and opened + RECOVERY_S * 1000 == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(("half_open", opened, streak))
            yield self._row(key, opened + RECOVERY_S * 1000, "half_open", streak)

    def close(self) -> None:
        pass


def breaker_changes(outcomes: DataFrame, mode: str = "EventTime") -> DataFrame:
    """(platform, at in milliseconds, status, streak) whenever a breaker changes, the half-open of a quiet platform too.

    outcomes: platform, at (milliseconds), seq, failed; with event time also a watermark on a column of its own. A
    breaker opens after CONSECUTIVE failures or MOST_ERRORS of its last WINDOW outcomes, half-opens RECOVERY_S later and
    then closes or opens again by one outcome, with a window begun anew.
    """
    return _grouped(outcomes, "platform", VISIT).transformWithState(_Breakers(), "platform string, at long, status string, streak int", "Append", mode)


class _Remembered(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        first = min((r.seq for r in rows if r.seq is not None), default=None)
        if first is not None and not self.seen.exists():
            yield Row(key=key[0], seq=first)
        self.seen.update((first or 0,))

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, ttl_s: float) -> DataFrame:
    """(key, seq) of keys that were not seen within ttl_s before, by the clock; every sighting lengthens a key's memory.

    rows: key (string), seq. Postings are remembered for 7 days, their fingerprints for 180.
    """
    return rows.groupBy("key").transformWithState(_Remembered(int(ttl_s * 1000)), "key string, seq long", "Append", "ProcessingTime")


def millis(time: str):
    return F.unix_millis(F.col(time).cast("timestamp"))
