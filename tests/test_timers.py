"""Streams whose state changes by timers and time to live."""

import time

import pytest
from pyspark.sql import functions as F

from spindrift.scratch import scratch_path
from spindrift.streaming import timers

HOUR = 3_600_000
#: When the tests begin: a stream's first watermark is the epoch, and rows not after it are late.
BASE = 1_700_000_000_000


@pytest.fixture
def store(spark):
    ((key, name),) = timers.STORE.items()
    before = spark.conf.get(key)
    spark.conf.set(key, name)
    yield spark
    spark.conf.set(key, before)


class Run:
    """A stream over folders of rows: each step adds one and reads what came out."""

    def __init__(self, spark, schema, flow):
        self.spark, self.schema, self.flow = spark, schema, flow
        self.path = scratch_path(spark, "timers")

    def step(self, rows, want=None):
        """Everything that came out so far. By the clock a stream never ends by itself: it is stopped once want came out, or after a while."""
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = self.flow(self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in"))
        sink = stream.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state")
        if want is None:
            sink.trigger(availableNow=True).start().awaitTermination(120)
            return self.found(stream.schema)
        running, until = sink.trigger(processingTime="300 milliseconds").start(), time.time() + 60
        while time.time() < until and (not running.recentProgress or self.found(stream.schema) != want):
            time.sleep(0.3)
        running.stop()
        return self.found(stream.schema)

    def found(self, schema):
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/out").collect()
        return sorted(tuple(x - BASE if isinstance(x, int) and x >= BASE else x for x in r) for r in rows)


OUTCOMES = "target string, platform string, at long, seq long, failed boolean, kind string, code int, asked double"


def outcomes(*rows):
    """(key, minute, failed[, kind, code, asked]) as rows of OUTCOMES."""
    return [(r[0], r[0], BASE + r[1] * 60_000, i, r[2], *[*r[3:], None, None, None][:3]) for i, r in enumerate(rows)]


def timed(flow):
    return lambda s: flow(s.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "1 minute"))


def test_retries_fall_due_without_a_row_of_their_own(store):
    run = Run(store, OUTCOMES, timed(timers.retries))
    assert run.step(outcomes(("a", 0, True), ("b", 0, True), ("c", 0, True, "anti_bot"), ("d", 0, True, None, 503, 120.0), ("e", 0, True, None, 404, None))) == []
    # b succeeds in time; other targets' rows move the clock past a's hour and d's two minutes.
    assert run.step(outcomes(("b", 30, False), ("x", 70, False))) == [("a", HOUR, 0), ("d", 120_000, 0)]
    # A second failure waits six hours, and replaces nothing that already fell due.
    assert len(run.step(outcomes(("a", 80, True), ("x", 400, False)))) == 2
    found = run.step(outcomes(("x", 80 + 361 + 2, False)))
    assert found[1] == ("a", 80 * 60_000 + 6 * HOUR, 1) and len(found) == 3
    week = 7 * 24 * 60
    assert {r[:2] for r in run.step(outcomes(("x", week + 10, False)))[3:]} | set() <= {("c", week * 60_000), ("e", week * 60_000), ("d", 120_000)}
    assert {r[0] for r in run.step(outcomes(("x", week + 20, False)))} == {"a", "c", "d", "e"}


def test_waits_of_a_target_that_keeps_failing():
    held, waits = None, []
    for _ in range(7):
        held = timers.retry_step(held, 0, "transient", None, None)
        waits.append((held[0], held[1] // HOUR))
    assert waits == [(0, 1), (1, 6), (2, 24), (0, 168), (1, 6), (2, 24), (0, 168)]
    assert timers.retry_step(None, 0, None, 429, 10**9)[1] == 168 * HOUR and timers.retry_step(None, 5, None, 429, 30)[1] == 30_005
    assert timers.retry_step((1, 0, False), 0, "bad_target", None, None)[:2] == (0, 168 * HOUR)


def test_a_quiet_breaker_half_opens_by_its_timer(store):
    run = Run(store, OUTCOMES, timed(timers.breaker_changes))
    assert run.step(outcomes(*[("a", i, True) for i in range(15)], ("b", 0, True))) == [("a", 14 * 60_000, "open", 15)]
    assert run.step(outcomes(("b", 40, False))) == [("a", 14 * 60_000, "open", 15)]
    # Nothing comes for a, but the hour is over.
    found = run.step(outcomes(("b", 80, False)))
    assert found[1:] == [("a", 14 * 60_000 + HOUR, "half_open", 15)]
    assert run.step(outcomes(("a", 90, True)))[2:] == [("a", 90 * 60_000, "open", 15)]
    # The next row is what finds the hour over; a success closes.
    found = run.step(outcomes(("a", 200, False), ("a", 201, True)))
    assert found[3:] == [("a", 150 * 60_000, "half_open", 15), ("a", 200 * 60_000, "closed", 0)]


def test_an_error_share_opens_and_its_window_is_kept_between_batches(store):
    run = Run(store, OUTCOMES, timed(timers.breaker_changes))
    assert run.step(outcomes(*[("a", i, i % 3 == 0) for i in range(12)])) == []
    assert run.step(outcomes(*[("a", 12 + i, i % 3 == 0) for i in range(12)])) == [("a", 19 * 60_000, "open", 0)]


def test_keys_are_forgotten_after_their_time(store):
    run = Run(store, "key string, seq long", lambda s: timers.first_seen(s, 20))
    first = [("a", 1), ("b", 3)]
    assert run.step([("a", 1), ("a", 2), ("b", 3)], first) == first
    assert run.step([("a", 4), ("c", 5)], [*first, ("c", 5)]) == [*first, ("c", 5)]
    time.sleep(21)
    again = sorted([*first, ("c", 5), ("a", 6), ("b", 7)])
    assert run.step([("a", 6), ("b", 7)], again) == again
