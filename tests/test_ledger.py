"""The sink that posts each row once, through crashes at every step."""

import pytest
from pyspark.sql import functions as F

from spindrift.scratch import scratch_path
from spindrift.streaming.ledger import Ledger

SCHEMA = "id long, title string, seen long"


class Crash(Exception):
    pass


def rows(spark, *found):
    return spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(found)], SCHEMA)


def posted(ledger, spark):
    return sorted((r.batch, r.id, r.title) for r in ledger.posted(spark, SCHEMA).collect())


def sink(ledger, at=0.0, step=lambda name: None):
    return ledger.sink(F.col("title"), [F.col("seen"), F.col("id")], lambda: at, step)


@pytest.mark.parametrize("where", ["begin", "rows", "ledger", "commit"])
def test_a_crash_at_any_step_posts_each_row_once(spark, where):
    ledger = Ledger(scratch_path(spark, "ledger"))
    sink(ledger)(rows(spark, (1, "a"), (2, "b"), (3, "a")), 0)

    def crash(name):
        if name == where:
            raise Crash

    batch = rows(spark, (4, "b"), (5, "c"), (6, "d"))
    with pytest.raises(Crash):
        sink(ledger, step=crash)(batch, 1)
    before = [(0, 1, "a"), (0, 2, "b")]
    assert posted(ledger, spark) == before + ([(1, 5, "c"), (1, 6, "d")] if where == "commit" else [])
    # The stream brings the batch again, with more rows in another order if it was not committed.
    again = batch if where == "commit" else rows(spark, (6, "d"), (5, "c"), (4, "b"), (7, "e"))
    sink(ledger)(again, 1)
    sink(ledger)(again, 1)
    assert posted(ledger, spark) == before + [(1, 5, "c"), (1, 6, "d")] + ([] if where == "commit" else [(1, 7, "e")])


def test_what_was_posted_long_ago_may_come_again(spark):
    ledger = Ledger(scratch_path(spark, "ledger"), memory_s=100)
    sink(ledger, 0)(rows(spark, (1, "a")), 0)
    sink(ledger, 100)(rows(spark, (2, "a"), (3, "b")), 1)
    sink(ledger, 150)(rows(spark, (4, "a"), (5, "b"), (6, None)), 2)
    assert posted(ledger, spark) == [(0, 1, "a"), (1, 3, "b"), (2, 4, "a")]


def test_a_stream_that_is_killed_after_its_write(spark):
    path = scratch_path(spark, "stream")
    ledger = Ledger(f"{path}/ledger")
    rows(spark, *[(i, f"t{i % 7}") for i in range(20)]).write.parquet(f"{path}/in")
    state = {"left": 1}

    def crash(name):
        if name == "ledger" and state["left"]:
            state["left"] = 0
            raise Crash

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
        stream.writeStream.foreachBatch(sink(ledger, step=crash)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination(120)

    with pytest.raises(Exception, match="Crash"):
        run()
    assert posted(ledger, spark) == []
    run()
    assert posted(ledger, spark) == [(0, i, f"t{i}") for i in range(7)]
    run()
    assert len(posted(ledger, spark)) == 7


def test_an_empty_ledger(spark):
    ledger = Ledger(scratch_path(spark, "ledger"))
    assert ledger.posted(spark, SCHEMA).count() == 0 and ledger.remembered(spark, 0.0).count() == 0
