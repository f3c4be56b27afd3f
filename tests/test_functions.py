import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindrift.functions import classify, dates, extract, text, urls


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_roles_and_early_careers(spark):
    rows = [("Machine Learning Engineer", None), ("Senior Software Engineer", 1), ("Software Engineer I", None), ("Software Engineer II", None), ("Marketing Intern", None), ("Internal Software Developer", None), ("Data Analyst", 1), ("Data Analyst", 5), ("New Grad Software Engineer", None), (None, None)]
    got = values(spark, rows, "t string, y int", classify.roles(F.col("t"), F.col("y")))
    assert got == [["AI/ML"], ["SWE"], ["New Grad", "SWE"], ["SWE"], [], ["SWE"], ["New Grad", "Data Analyst"], ["Data Analyst"], ["New Grad", "SWE"], []]


def test_failures_by_code_and_words(spark):
    rows = [(404, ""), (429, ""), (403, ""), (None, "read timeout"), (None, "connection reset"), (None, "json decode failed"), (None, "no jobs"), (503, ""), (200, "odd"), (None, None)]
    got = values(spark, rows, "s int, e string", classify.failure(F.col("s"), F.col("e")))
    assert got == ["bad_target", "rate_limited", "anti_bot", "timeout", "connection", "parse", "empty_board", "connection", "unknown", "unknown"]


def test_us_places(spark):
    rows = [("San Francisco, CA",), ("Remote",), ("London",), ("Cork, IE",), ("",), (None,), ("Austin, TX",), ("Mars",), ("Remote - India",)]
    assert values(spark, rows, "l string", classify.is_us_strict(F.col("l"))) == [True, True, False, False, False, False, True, False, False]
    assert values(spark, rows, "l string", classify.is_us_permissive(F.col("l"))) == [True, True, False, False, True, True, True, True, False]


def test_quality_states_and_gates(spark):
    rows = [
        ("Software Engineer", "Acme", "https://boards.greenhouse.io/acme/jobs/1", "greenhouse", "New York, NY"),
        ("1,200+ engineer jobs hiring", "Acme", "https://indeed.com/q=x", "indeed", "New York, NY"),
        ("Engineer", "Unknown", "https://x.io/a", "rss", "Remote"),
        ("Engineer", "Engineer @ Acme", "nowhere", "lever", "Remote"),
    ]
    schema = "t string, c string, u string, s string, l string"
    got = values(spark, rows, schema, classify.quality(*map(F.col, "tcus")))
    assert [(g.state, g.confidence) for g in got] == [("accepted", 1.0), ("rejected", 0.0), ("needs_review", 0.3), ("rejected", 0.4)]
    assert set(got[3].reasons) == {"invalid_apply_url", "malformed_company_title"}
    gates = values(spark, rows, schema, classify.first_failure(*map(F.col, "tclus")))
    assert gates == [None, "generic_title", "unknown_company", "invalid_url"]


def test_scores(spark):
    rows = [("Machine Learning Engineer", "x" * 600, 100000.0, ["AI/ML"], True), ("Director of Sales", "", None, [], False)]
    got = values(spark, rows, "t string, d string, s double, k array<string>, h boolean", classify.quality_score(*map(F.col, "tdskh")))
    assert got == [83.0, 0.0]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Salary range: $100k - $150k", (100000.0, 150000.0, "USD")),
        ("<b>$130,900 &ndash; $177,100</b> per year", (130900.0, 177100.0, "USD")),
        ("€80.000 - €95.000", None),
        ("pays £90,000 to £110,000", (90000.0, 110000.0, "GBP")),
        ("raised a billion and more, was $100,000 - $200,000", None),
        ("$45 - $65 per hour", None),
        ("no pay told", None),
        ("", None),
    ],
)
def test_salaries(spark, said, want):
    got = values(spark, [(said,)], "d string", extract.salary(F.col("d")))[0]
    assert (tuple(got) if got else None) == want


def test_experience_and_enrichment(spark):
    rows = [("3-5 years of experience",), ("at least 2 years of relevant experience",), ("7+ years building systems",), ("none",), (None,)]
    assert values(spark, rows, "d string", extract.experience_years(F.col("d"))) == [3, 2, 7, None, None]
    rows = [("We use C++, Python and Next.js; we do not sponsor visas. Hybrid, part-time.",)]
    one = spark.createDataFrame(rows, "d string").select(extract.technologies(F.col("d")).alias("t"), extract.visa(F.col("d")).alias("v"), extract.work_mode(F.lit("x"), F.col("d"), F.lit("NYC")).alias("m"), extract.job_type(F.lit("x"), F.col("d")).alias("j"), extract.level(F.lit("Sr. Engineer")).alias("l")).first()
    assert one.t == ["Next.js", "Python"] and one.v is False and (one.m, one.j, one.l) == ("hybrid", "part_time", "senior")


def test_dates_and_windows(spark):
    now = F.lit("2026-03-05 12:00:00").cast("timestamp")
    rows = [("2026-03-05T01:00:00Z",), ("2026-03-01T01:00:00Z",), ("2026-03-04",), ("Thu, 05 Mar 2026 10:00:00 +0000",), ("1772700000",), ("1772700000000",), ("30+ Days Ago",), ("1 day ago",), ("2 months ago",), ("soon",), (None,), ("",)]
    assert values(spark, rows, "d string", dates.within(F.col("d"), now, 24)) == [True, False, True, True, True, True, False, True, False, True, True, True]


def test_addresses(spark):
    rows = [("https://boards.greenhouse.io/acme/jobs/1?utm_source=x&a=b",), ("https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/1",), ("https://jobs.lever.co/beta/2?utm_source=x",), ("https://GAMMA.bamboohr.com/careers",), ("junk",)]
    got = values(spark, rows, "u string", urls.target(F.col("u")))
    assert [(g.platform, g.slug) for g in got] == [("greenhouse", "acme"), ("workday", "acme:wd5:Careers"), ("lever", "beta"), ("bamboohr", "GAMMA"), (None, None)]
    assert values(spark, rows, "u string", urls.without_tracking(F.col("u")))[:3] == ["https://boards.greenhouse.io/acme/jobs/1?a=b", "https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/1", "https://jobs.lever.co/beta/2"]


def test_text(spark):
    rows = [("<p>Tom &amp; Ann</p>\n x",), (None,)]
    assert values(spark, rows, "h string", text.html_to_text(F.col("h"))) == ["Tom & Ann x", ""]
    assert values(spark, [("Senior Data Engineer (Remote) - Austin",)], "t string", text.title_key(F.col("t"))) == ["data engineer"]
    assert values(spark, [("unknown",), ("a" * 50,), ("NYC",)], "l string", text.location_label(F.col("l"))) == ["Remote", "a" * 39 + "...", "NYC"]
    assert values(spark, [("see https://a.b/c 日本",)], "t string", text.weighted_length(F.col("t"))) == [4 + 23 + 1 + 4]


def test_priorities(spark):
    now = F.lit("2026-03-05 12:00:00").cast("timestamp")
    rows = [("P0", 3, 10, 2, 0, dt.datetime(2026, 3, 5, 1)), (None, None, None, None, 2, None)]
    got = values(spark, rows, "t string, s int, j int, r int, f int, l timestamp", classify.priority(*map(F.col, "tsjrfl"), now))
    assert got == [100 + 1.5 + 2 + 3 + 25, 20 + 0.5 - 16]
    rows = [("P0", 0, 0, 0, True), ("P2", 0, 5, 1, False), ("P3", 6, 0, 0, False), ("P1", 5, 0, 0, False)]
    got = values(spark, rows, "t string, f int, j int, r int, x boolean", classify.next_due_seconds(*map(F.col, "tfjrx")))
    assert got == [1800, 3600, 604800, 10800]


def test_references_resolve_as_the_standard_library_does(spark):
    import html
    import random

    rnd = random.Random(7)
    made = ["Caf&eacute; &#x27;a&#x27; &#8211; &copy;", "&amp;lt;", "&copy2023 &ampx &notit; &notin;", "&#0;&#13;&#128;&#x9f;&#xD800;&#1114112;&#99999999999999;&#x1F600;&#xfffe;&#11;&#x;&#;&;& &", "", None, "no reference", "&CounterClockwiseContourIntegral;&NotEqualTilde;", "&unknown; &#65 b &#x41g"]
    made += ["".join(rnd.choice(["&", "#", "x", ";", "amp", "lt", "copy", "not", "in", "65", "1F", " ", "é", "eacute;"]) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    got = values(spark, [(t,) for t in made], "t string", text.unescape(F.col("t")))
    assert got == [None if t is None else html.unescape(t) for t in made]
