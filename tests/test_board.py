import datetime as dt

from pyspark.sql import functions as F

from spindrift.operators import board


def now():
    return F.lit("2026-03-05 12:00:00").cast("timestamp")


def test_snapshot(spark):
    at = dt.datetime(2026, 3, 5)
    rows = [("h1", "1", "ML Engineer", "Acme", "San Francisco, CA", "https://a", None, "greenhouse", ["AI/ML"], at), ("h2", "2", "Software Engineer", None, "Remote", "https://b", "2026-03-04", "some-board", [], at), ("h3", "3", "Engineer", "Acme", "London", "https://c", None, "lever", [], at), ("h4", "4", "Engineer", "Acme is looking for X in", "Cork", "https://d", None, "lever", [], at)]
    df = spark.createDataFrame(rows, "internal_hash string, job_id string, title string, company string, location string, url string, date_posted string, source_ats string, keywords_matched array<string>, first_seen timestamp")
    got = board.snapshot(df).collect()
    assert [(r.id, r.category, r.company, r.source) for r in got] == [("h1", "AI/ML", "Acme", "Greenhouse"), ("h2", "SWE", "some board", "some board")]
    assert board.back_fill(df.limit(1), df, "internal_hash", [F.col("internal_hash")], 3).count() == 3


def test_decisions_and_merges(spark):
    runs = spark.createDataFrame([('{"platforms": {"lever": {}}}', True, dt.datetime(2026, 3, 5, 11)), ('{"platforms": {"ashby": {}}}', True, dt.datetime(2026, 3, 5, 11, 59)), ("junk", True, dt.datetime(2026, 3, 5, 12))], "summary_json string, success boolean, run_at timestamp")
    assert board.due_decision(runs, ["lever"], now(), 75).first().due is False
    assert board.due_decision(runs, ["lever"], now(), 20).first().due is True
    assert board.due_decision(runs, ["gem"], now(), 20).first().due is True
    schema = "ats_type string, slug string, tier string, priority_score double"
    got = board.seed(spark.createDataFrame([("lever", "a", "P0", 1.0), ("lever", "b", "P3", 9.0)], schema), spark.createDataFrame([("lever", "a", "P1", 5.0), ("lever", "b", "P1", 2.0), ("lever", "c", "P2", 3.0)], schema))
    assert {r.slug: (r.tier, r.priority_score) for r in got.collect()} == {"a": ("P0", 5.0), "b": ("P1", 9.0), "c": ("P2", 3.0)}
    rows = spark.createDataFrame([("p", i) for i in range(9)] + [("q", 1)], "g string, i int")
    assert board.fair_claim(rows, "g", [F.col("i")], spark.createDataFrame([("p", 2)], "g string, cap int"), 5).count() == 5
    lines = board.exposition(spark.createDataFrame([("jobs total", None, 3), ("jobs", "lever", 2)], "name string, label string, value long"), "x").collect()
    assert [r.value for r in lines] == ["x_jobs_total 3", 'x_jobs{label="lever"} 2']


def test_browser_facets(spark):
    df = spark.createDataFrame([("Senior C++ Engineer", "acmeCorp", 7), ("Analyst", "x @ Beta", None)], "t string, c string, y int")
    got = df.select(board.all_tokens([F.col("t"), F.col("c")], "c++ acme").alias("a"), board.experience_bucket(F.col("y"), F.col("t")).alias("b"), board.display_company(F.col("c"), {"beta": "BETA"}).alias("d")).collect()
    assert [(r.a, r.b, r.d) for r in got] == [(True, "senior", "Acme Corp"), (False, "mid", "BETA")]
