"""Folds over ordered rows: the same as one loop a key, wherever the ranges are cut."""

import random

import pytest

from spindrift.operators import fold


@pytest.fixture
def ranges(spark):
    """As many ranges as partitions, even of small tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(rows, step, start):
    out, states = {}, {}
    for k, i, failed in sorted(rows, key=lambda r: r[1]):
        states[k], made = step(states.get(k, start), {"failed": failed})
        out[k, i] = tuple(made.values())
    return out


def visits(seed, n, rate):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows, bad = [], False
    for i in range(n):
        bad = rng.random() < (0.9 if bad else rate)  # failures come in runs
        rows.append((rng.choice(keys), i, rng.random() < 0.8 if bad else rng.random() < 0.1))
    return rows


@pytest.mark.parametrize(("seed", "rate"), [(1, 0.02), (2, 0.05), (3, 0.3)])
def test_breakers_over_ranges(ranges, seed, rate):
    rows = visits(seed, 3000, rate)
    got = fold.breakers(ranges.createDataFrame(rows, "platform string, seq long, failed boolean").repartition(3), ["platform"], ["seq"])
    got = {(r.platform, r.seq): (r.visited, r.status) for r in got.collect()}
    want = plain(rows, fold.breaker, [0, "", None])
    assert got == want and {s for _, s in want.values()} == {"closed", "open", "half_open"}


def test_a_machine_that_never_forgets(ranges):
    rows = visits(4, 400, 0.1)

    def count(state, row):
        return [state[0] + 1], {"n": state[0] + 1}

    got = fold.fold(ranges.createDataFrame(rows, "platform string, seq long, failed boolean"), ["platform"], ["seq"], ["failed"], count, [0], "n long")
    assert {(r.platform, r.seq): (r.n,) for r in got.collect()} == plain(rows, count, [0])


def test_a_breaker_step_by_step():
    def run(outcomes):
        state, seen = [0, "", None], []
        for failed in outcomes:
            state, out = fold.breaker(state, {"failed": failed})
            seen.append((out["visited"], out["status"]))
        return seen

    fifteen = run([True] * 80)
    # The share of failures trips at the twentieth visit at the latest, fifteen in a row trip before.
    assert fifteen[13] == (True, "closed") and fifteen[14] == (True, "open")
    assert fifteen[15:65] == [(False, "open")] * 49 + [(False, "half_open")] and fifteen[65] == (True, "half_open")
    mixed = run([i % 3 == 0 for i in range(22)])
    assert mixed[19] == (True, "closed") and mixed[21] == (True, "open")  # a success does not trip, the next failure does
    healed = run([i % 3 == 0 for i in range(22)] + [True] * 50 + [False] * 5)
    assert healed[-2] == (True, "half_open") and healed[-1] == (True, "closed")  # 8 failures of 26, then of 27
    assert run([True] * 65 + [False])[-1] == (True, "closed")  # of fewer than twenty outcomes no share is taken


def test_odd_visits(ranges):
    frame = ranges.createDataFrame([(None, 1, None), ("a", 2, True)], "platform string, seq long, failed boolean")
    assert sorted((r.platform or "", r.visited, r.status) for r in fold.breakers(frame, ["platform"], ["seq"]).collect()) == [("", True, "closed"), ("a", True, "closed")]
    assert fold.breakers(frame.where("seq > 5"), ["platform"], ["seq"]).count() == 0
