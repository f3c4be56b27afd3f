"""Objects in script text and postings of start-up pages."""

import json
import random

from pyspark.sql import functions as F

from spindrift.sources.scripts import balanced_objects, object_after, objects_in, startup_postings


def test_objects_end_where_their_brace_closes():
    rng = random.Random(2)
    for _ in range(300):
        made = [json.dumps({rng.choice(["a", 'q"', "{", "\\"]): rng.choice(["}", '"', "\\", "{x}", "é", {"b": ["{", {"c": "}"}]}])}, ensure_ascii=rng.random() < 0.5) for _ in range(rng.randint(0, 4))]
        text = "".join(rng.choice(["var x = ", "; ", "} ", "[", "it's "]) + m for m in made) + rng.choice(["", ";", " { unclosed"])
        assert [text[a:b] for a, b in balanced_objects(text)] == made


def test_the_first_object_that_reads_counts():
    text = 'window.a = {broken: 1}; window.state = {not json}; more {"x": {"y": "}"}} {"z": 1}'
    assert object_after(text, "window.state") == {"x": {"y": "}"}} and object_after(text, "nothing") is None and object_after("x = 5", "x") is None


def pages(spark, *html):
    return spark.createDataFrame([(h, "t", "u") for h in html], "html string, title string, url string")


def found(spark, *html):
    return sorted((r.job_id, r.title, r.company, r.location, r.url) for r in startup_postings(pages(spark, *html)).collect())


def test_cards_take_what_stands_near(spark):
    far = "x" * 700
    html = f'<a href="/jobs/1">Data &amp; Co <b>Engineer</b></a><span class="job-location">Oslo</span>{far}<div data-company="Acme"></div><a href="/jobs/2" class="k">Analyst</a>{far}<a href="/jobs/3">ab</a><a href="/jobs/2">Analyst again</a>'
    site = "https://www.workatastartup.com/jobs/"
    assert found(spark, html) == [("yc_1", "Data & Co Engineer", "YC Startup", "Oslo", f"{site}1"), ("yc_2", "Analyst", "Acme", "Remote", f"{site}2")]


def test_structured_blocks_and_payloads(spark):
    block = '<script type="application/ld+json">[{"@type": "JobPosting", "title": "SRE", "hiringOrganization": {"name": "Initech"}, "jobLocation": {"address": {"addressRegion": "Fully remote"}}, "url": "https://x/jobs/77", "datePosted": "2024-01-01"}]</script>'
    payload = '<script id="__NEXT_DATA__">{"props": {"pageProps": {"jobListings": [{"job_id": 9, "job_title": "QA }", "company": "Umbrella", "location": "Lyon"}, {"title": ""}, 5, {"title": "No id", "company": {"company_name": "X"}}]}}}; boot();</script>'
    assert [r[:4] for r in found(spark, block + payload)] == [("yc_77", "SRE", "Initech", "Remote")]
    rows = found(spark, payload)
    assert ("yc_9", "QA }", "Umbrella", "Lyon", "https://www.workatastartup.com/jobs/9") in rows and len(rows) == 2
    hashed = next(r for r in rows if r[1] == "No id")
    assert len(hashed[0]) == 15 and hashed[2:4] == ("X", "Remote")


def test_damaged_and_empty_pages(spark):
    broken = '<script type="application/ld+json">{"@type": "JobPosting",</script><script id="__NEXT_DATA__">{"props": [1]}</script>'
    assert found(spark, broken, "", None, "/jobs/ but no link", '<script type="application/ld+json">7</script>') == []


def test_objects_as_a_column(spark):
    frame = spark.createDataFrame([(1, 'x = {"b": 1, "a": "é"};'), (2, None), (3, "y"), (4, "x = {oops}")], "id long, t string")
    assert {r.id: r.o for r in frame.select("id", objects_in(F.col("t"), "x =").alias("o")).collect()} == {1: '{"a": "é", "b": 1}', 2: None, 3: None, 4: None}


def test_hiring_lines(spark):
    from spindrift.sources.pages import hiring_line

    lines = {"Acme Corp | Software Engineer | Remote": ("Acme Corp", "Software Engineer"), "Acme (YC S22) - Backend Engineer": ("Acme (YC S22)", "Backend Engineer"), "Acme — Data - Lead": ("Acme", "Data - Lead"), "Software Engineer AT Acme Corp": ("Acme Corp", "Software Engineer"), "Acme Corp: we are hiring": ("Acme Corp", ""), "x" * 100: ("x" * 80, ""), "|": ("", ""), "": ("", ""), None: ("", "")}
    frame = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: (r.h.company, r.h.title) for r in frame.select("line", hiring_line(F.col("line")).alias("h")).collect()} == lines


def test_boards_that_pages_embed(spark):
    from spindrift.functions.urls import page_target

    found = {'<script src="https://boards.greenhouse.io/embed/job_board/js/acme">': ("greenhouse", "acme"), "see https://jobs.lever.co/ac-me/1 or https://jobs.ashbyhq.com/x": ("lever", "ac-me"), "https://acme.wd5.myworkdayjobs.com/site": ("workday", None), "workable.com/widget/job_board?x": ("workable", None), "nothing": (None, None), None: (None, None)}
    frame = spark.createDataFrame([(k,) for k in found], "html string")
    assert {r.html: (r.t.platform, r.t.slug) for r in frame.select("html", page_target(F.col("html")).alias("t")).collect()} == found
