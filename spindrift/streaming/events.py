"""Streams: dedup, windows, poll-and-mark batches, circuit breakers and retry schedules with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, time: str = "ts", most_files: int | None = 1) -> DataFrame:
    """A stream of Parquet files; the time column becomes a timestamp, as watermarks need.

    most_files are read in a trigger, all that wait if none: files that overlap in time must come together, as rows
    behind the watermark of an earlier trigger are late and dropped.
    """
    source = spark.readStream.schema(schema)
    rows = (source.option("maxFilesPerTrigger", most_files) if most_files else source).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def distinct(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "7 days") -> DataFrame:
    """The first row of each key; keys are forgotten after the delay, which bounds the state."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(events: DataFrame, keys: list[str], time: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    out = events.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    out = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def fresh_only(events: DataFrame, now, hours: int, time: str = "ts") -> DataFrame:
    """Rows of the last hours; unknown times are kept."""
    return events.where(F.coalesce(F.col(time) >= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(True)))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that is there, in batches, then stop; sink must be idempotent for a batch id."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: What trips a breaker, how long it stays open, waits between tries in seconds.
CONSECUTIVE, WINDOW, LEAST_SAMPLES, MOST_ERRORS, RECOVERY_S = 15, 50, 20, 0.3, 3600
RETRY_S, REVIEW_S = (3600, 21_600, 86_400), 604_800


def breaker_step(state: dict, failed: bool, at: float) -> dict:
    """A breaker after one outcome: closed, open (until recovery), half_open (one try decides)."""
    state = dict(state)
    if state["status"] == "open" and at - state["opened"] >= RECOVERY_S:
        state["status"] = "half_open"
    if state["status"] == "half_open":
        return {"status": "open", "opened": at, "streak": state["streak"], "last": []} if failed else {"status": "closed", "opened": 0.0, "streak": 0, "last": []}
    state["streak"] = state["streak"] + 1 if failed else 0
    state["last"] = (state["last"] + [int(failed)])[-WINDOW:]
    n = len(state["last"])
    if state["status"] == "closed" and (state["streak"] >= CONSECUTIVE or n >= LEAST_SAMPLES and sum(state["last"]) / n >= MOST_ERRORS):
        state["status"], state["opened"] = "open", at
    return state


def _breaker(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = {"status": "closed", "opened": 0.0, "streak": 0, "last": []}
    if state.exists:
        status, opened, streak, last = state.get
        held = {"status": status, "opened": opened, "streak": streak, "last": [int(c) for c in last]}
    # Only what the fold needs is held, some bytes an outcome of one trigger; its order needs them together.
    rows = pd.concat([b[["at", "seq", "failed"]] for b in batches]).sort_values(["at", "seq"])
    for failed, at in zip(rows.failed, rows["at"], strict=True):
        held = breaker_step(held, bool(failed), float(at))
    state.update((held["status"], held["opened"], held["streak"], "".join(map(str, held["last"]))))
    yield pd.DataFrame({"platform": [key[0]], "status": [held["status"]], "streak": [held["streak"]]})


def breakers(outcomes: DataFrame) -> DataFrame:
    """(platform, status, streak) after each batch of outcomes (platform, seq, at in seconds, failed); state is kept by platform."""
    return outcomes.groupBy("platform").applyInPandasWithState(_breaker, "platform string, status string, streak int", "status string, opened double, streak int, last string", "update", GroupStateTimeout.NoTimeout)


#: Least requests a second, first pause and longest one, longest wait a server may ask for, recovery a success.
LEAST_RATE, PAUSE_S, MOST_PAUSE_S, MOST_ASKED_S, RECOVERY = 0.05, 10.0, 600.0, 900.0, 1.2


def pace_step(state: dict, limited: bool, at: float, asked: float | None = None) -> dict:
    """A host's pace after one answer: a refusal halves the rate and doubles the pause (a server's own wait counts if longer), a success restores a fifth."""
    state = dict(state)
    if limited:
        state["refusals"] += 1
        state["rate"] = max(LEAST_RATE, state["rate"] * 0.5)
        pause = min(PAUSE_S * 2 ** min(state["refusals"] - 1, 10), MOST_PAUSE_S)
        state["until"] = at + max(pause, min(asked, MOST_ASKED_S) if asked and asked > 0 else 0.0)
    else:
        state["refusals"], state["rate"] = 0, min(state["base"], state["rate"] * RECOVERY) if state["rate"] < state["base"] else state["rate"]
    return state


def _pace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat([b[["at", "seq", "limited", "asked", "base"]] for b in batches]).sort_values(["at", "seq"])
    base = float(rows.base.iloc[0])
    held = dict(zip(("base", "rate", "refusals", "until"), state.get, strict=True)) if state.exists else {"base": base, "rate": base, "refusals": 0, "until": 0.0}
    for limited, at, asked in zip(rows.limited, rows["at"], rows.asked, strict=True):
        held = pace_step(held, bool(limited), float(at), None if pd.isna(asked) else float(asked))
    state.update((held["base"], held["rate"], held["refusals"], held["until"]))
    yield pd.DataFrame({"host": [key[0]], "rate": [held["rate"]], "refusals": [held["refusals"]], "until": [held["until"]]})


def paces(answers: DataFrame) -> DataFrame:
    """(host, rate, refusals, until) after each batch of answers (host, seq, at in seconds, limited, asked, base); state is kept by host.

    Ceilings of whole platforms are the same fold over answers whose host is the platform.
    """
    return answers.groupBy("host").applyInPandasWithState(_pace, "host string, rate double, refusals int, until double", "base double, rate double, refusals int, until double", "update", GroupStateTimeout.NoTimeout)


def next_retry(failures, at, retry_after=None):
    """When a failed target is tried again: 1 h, 6 h, 24 h, then review after 7 days; a server's own wait counts if longer, up to a day."""
    wait = F.when(failures <= 1, RETRY_S[0]).when(failures == 2, RETRY_S[1]).when(failures == 3, RETRY_S[2]).otherwise(REVIEW_S)
    if retry_after is not None:
        wait = F.greatest(wait, F.least(F.coalesce(retry_after, F.lit(0)), F.lit(86_400)))
    return at + F.make_dt_interval(secs=wait)


def needs_visit(targets: DataFrame, state: DataFrame, now, intervals: dict[str, int], default_s: int) -> DataFrame:
    """Targets whose last visit is longer ago than their platform's interval, three times that after five empty visits."""
    base = F.coalesce(*[F.when(F.col("ats") == p, F.lit(s)) for p, s in intervals.items()], F.lit(default_s))
    wait = F.when(F.col("consecutive_empty") >= 5, base * 3).otherwise(base)
    joined = targets.join(state, ["ats", "slug"], "left")
    due = F.col("last_scraped").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_scraped") >= wait)
    return joined.where(due).select(targets.columns)
