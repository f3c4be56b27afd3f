"""Stored sketches, footers, stale rows by board, health of platforms."""

import json
import random

from pyspark.sql import functions as F

from spindrift.operators import rollups, sketches, tables
from spindrift.scratch import materialise, scratch_path
from spindrift.sources.footers import footer_bounds


def test_merged_days_are_near_the_exact_figures(spark):
    rng = random.Random(3)
    rows = [(i % 5, "ab"[i % 2], rng.randrange(6000), rng.expovariate(1.0) if i % 97 else None) for i in range(40_000)]
    frame = spark.createDataFrame(rows, "d int, k string, user long, value double").repartition(7)
    days = materialise(sketches.daily(frame, F.col("d"), ["k"], {"users": F.col("user")}, {"value": F.col("value")}), "days")
    assert days.count() == 10
    for k, n, users, low, mid in sketches.merged(days.where("day >= 2"), ["k"], ["users"], {"low": ("value", 0.1), "mid": ("value", 0.5)}).collect():
        mine = [r for r in rows if r[0] >= 2 and r[1] == k]
        values = sorted(r[3] for r in mine if r[3] is not None)
        assert n == len(mine) and abs(users - len({r[2] for r in mine})) <= 0.03 * len({r[2] for r in mine})
        assert all(abs(sum(v <= x for v in values) / len(values) - q) < 0.02 for x, q in ((low, 0.1), (mid, 0.5)))
    none = sketches.merged(sketches.daily(frame.where("k = 'c'"), F.col("d"), ["k"], {"users": F.col("user")}, {"value": F.col("value")}), ["k"], ["users"], {"mid": ("value", 0.5)})
    assert none.count() == 0
    nulls = sketches.daily(spark.createDataFrame([(1, "a", None, None)], "d int, k string, user long, value double"), F.col("d"), ["k"], {"users": F.col("user")}, {"value": F.col("value")})
    assert [tuple(r) for r in sketches.merged(nulls, ["k"], ["users"], {"mid": ("value", 0.5)}).collect()] == [("a", 1, 0, None)]


def test_footers_answer_without_data_pages(spark):
    path = scratch_path(spark, "counted")
    spark.range(1000).select("id", (F.col("id") % 7 - 3).cast("int").alias("x"), F.lit("text").alias("t")).repartition(3).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    bounds = footer_bounds(spark, path, ["id", "x"])
    assert tuple(bounds.first()) == (1000, 0, 999, -3, 3) and spark.conf.get("spark.sql.sources.useV1SourceList") == before
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id), MIN(x), MAX(x)]" in plan


def test_stale_rows_by_board_and_id(spark):
    current = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("C", 1), ("D", 9)], "board string, id long")
    latest = spark.createDataFrame([("A", 2), ("B", 1)], "board string, id long")
    assert [tuple(r) for r in tables.stale(current, latest, "id", ["board"]).select("board", "id").collect()] == [("A", 1)]
    fetched = spark.createDataFrame([("A",), ("B",), ("C",)], "board string")
    assert sorted(tuple(r) for r in tables.stale(current, latest, "id", ["board"], fetched).select("board", "id").collect()) == [("A", 1), ("C", 1)]


def test_health_reads_each_summary_once(spark):
    runs = [{"platforms": {"lever": {"attempted": 100, "succeeded": 80, "failed": 20, "jobs_fetched": 5}, "idle": {"attempted": 0}}, "failure_breakdown": {"lever": {"rate_limited": 12, "bad_target": 8}, "other": {"timeout": 3}}}, {"platforms": {"lever": {"attempted": 100, "succeeded": 90, "failed": 10}}, "failure_breakdown": {"lever": {"timeout": 4, "bad_target": 6}}}, {"platforms": {"lever": {"attempted": 0}}}]
    frame = spark.createDataFrame([(json.dumps(r),) for r in runs] + [("{junk",), (None,), ("[]",)], "summary_json string")
    out = rollups.platform_health(frame)
    assert {r.platform: tuple(r)[1:] for r in out.collect()} == {"lever": (200, 170, 30, 5, 0.85, 0.15, 0.08), "idle": (0, 0, 0, 0, None, None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
