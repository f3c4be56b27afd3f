import datetime as dt
import json

from spindrift.sources import boards, pages, registry


def payload(spark, platform, slug, value):
    rows = [(platform, "Acme", slug, json.dumps(value)), (platform, "Bad", slug, "<html>")]
    return boards.read_board(spark.createDataFrame(rows, "platform string, company string, slug string, payload string"), platform).collect()


def test_greenhouse(spark):
    (j,) = payload(spark, "greenhouse", "acme", {"jobs": [{"id": 7, "title": "Engineer", "created_at": "2026-01-01", "location": {"name": "NYC"}, "content": "&lt;p&gt;Hi&lt;/p&gt;"}]})
    assert (j.job_id, j.location, j.date_posted, j.url, j.description) == ("7", "NYC", "2026-01-01", "https://boards.greenhouse.io/acme/jobs/7", "Hi")


def test_lever(spark):
    (j,) = payload(spark, "lever", "acme", [{"id": "a", "text": "Dev", "createdAt": 1767225600000, "categories": {"location": ["NYC", "Remote"]}, "descriptionPlain": "One", "lists": [{"text": "Do", "content": "<li>x</li>"}], "additionalPlain": "End", "hostedUrl": "https://l"}])
    assert (j.location, j.date_posted, j.description, j.url) == ("NYC, Remote", "2026-01-01T00:00:00Z", "One Do x End", "https://l")


def test_oracle_and_workday(spark):
    page = {"items": [{"TotalJobsCount": 2, "requisitionList": [{"Id": "1", "Title": "Eng", "PrimaryLocation": "NYC", "secondaryLocations": [{"Name": "SF"}], "PostedDate": "2026-01-02"}, {"Id": "", "Title": "x"}]}]}
    (j,) = payload(spark, "oracle", "h.example:CX", page)
    assert (j.location, j.url) == ("NYC, SF", "https://h.example/hcmUI/CandidateExperience/en/sites/CX/job/1")
    (j,) = payload(spark, "workday", "acme:wd5:Careers", {"jobPostings": [{"title": "Eng", "externalPath": "/job/1", "bulletFields": ["R1", "Posted 3 Days Ago"]}]})
    assert (j.job_id, j.date_posted, j.location, j.url) == ("/job/1", "Posted 3 Days Ago", "Unknown", "https://acme.wd5.myworkdayjobs.com/Careers/job/1")


def test_every_board_reads_an_empty_list(spark):
    rows = [(p, "Acme", "s:t:u", "[]") for p in boards.BOARDS] + [(p, "Acme", "s:t:u", "{}") for p in boards.BOARDS]
    assert boards.read_all(spark.createDataFrame(rows, "platform string, company string, slug string, payload string")).count() == 0


def test_json_ld(spark):
    def page(*scripts):
        return "<html>" + "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts) + "</html>"

    one = {"@type": "JobPosting", "title": "Engineer", "url": "https://c/1", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX"}}, "baseSalary": {"currency": "USD", "value": {"minValue": "100,000", "maxValue": 150000}}}
    far = {"@type": ["Thing", "jobposting"], "title": "Remote dev", "jobLocationType": "TELECOMMUTE", "baseSalary": {"value": 5}}
    rows = [("https://a", page(json.dumps(one))), ("https://b", page("{bad", json.dumps({"@graph": [far, {"@type": "JobPosting"}]}))), ("https://c", page('{"@type":"JobPosting","title":"T"} trailing')), ("https://d", "<html></html>")]
    got = {r.url: r for r in pages.json_ld(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert set(got) == {"https://c/1", "https://b", "https://c"}
    assert (got["https://c/1"].location, got["https://c/1"].salary_min, got["https://c/1"].salary_max, got["https://c/1"].company) == ("Austin, TX", 100000.0, 150000.0, "Acme")
    assert (got["https://b"].location, got["https://b"].salary_min, got["https://b"].company) == ("Remote", 5.0, "Unknown")


def test_sitemaps_and_crawl_lines(spark):
    rows = [("<urlset><url><loc> https://a </loc></url><url><loc>https://b</loc></url></urlset>",), ("<html><loc>x</loc></html>",)]
    assert [r.url for r in pages.sitemap_urls(spark.createDataFrame(rows, "html string")).collect()] == ["https://a", "https://b"]
    lines = spark.createDataFrame([('{"url": "https://a"}',), ("<html>error</html>",), ("",), ('{"url": "https://a"}',)], "value string")
    assert [r.url for r in pages.crawl_index_urls(lines).collect()] == ["https://a"]


def test_markdown_tables(spark):
    text = "\n".join(["# Jobs", "| Company | Role | Location | Link | Date |", "|---|---|---|---|---|", "| **[Acme](https://acme)** | Engineer | NYC | [Apply](https://a/1) | Jan 1 |", '| ↳ | Analyst | SF | <a href="https://a/2">x</a> | Jan 2 |', "| Beta | Closed role | LA | 🔒 | Jan 3 |"])
    got = pages.markdown_rows(spark.createDataFrame([("f", text)], "path string, text string"), "list").orderBy("url").collect()
    assert [(r.company, r.title, r.location, r.url, r.date_posted) for r in got] == [("Acme", "Engineer", "NYC", "https://a/1", "Jan 1"), ("Acme", "Analyst", "SF", "https://a/2", "Jan 2")]


def test_feeds_threads_results(spark):
    items = spark.createDataFrame([("Acme: Engineer", "https://x", None, "<p>d</p>"), ("Plain", "https://y", "now", None)], "title string, link string, pubDate string, description string")
    assert [(r.company, r.title) for r in pages.rss(items, "rss").collect()] == [("Acme", "Engineer"), ("Unknown", "Plain")]
    at = dt.datetime(2026, 3, 2)
    rows = [(1, "Acme | Senior Engineer | Remote (US) | Full-time<p>See <a href=\"https://acme\">us</a>", at), (2, "Acme | Designer | NYC<p>again", at), (3, "just chatting", at)]
    got = pages.thread_comments(spark.createDataFrame(rows, "id long, html string, created timestamp")).collect()
    assert [(r.job_id, r.company, r.title, r.location, r.url) for r in got] == [("hn_acme_2026-03", "Acme", "Senior Engineer", "Remote (US)", "https://acme")]
    rows = [("Engineer - Acme - NYC | Board", "https://a", None), ("Analyst at Beta", "https://b", None)]
    got = pages.search_results(spark.createDataFrame(rows, "title string, url string, description string")).collect()
    assert [(r.title, r.company, r.location) for r in got] == [("Engineer", "Acme", "NYC"), ("Analyst", "Beta", "Unknown")]


def test_registry(spark):
    rows = [("A", "greenhouse", "https://boards.greenhouse.io/a"), ("B", "lever", "https://boards.greenhouse.io/b"), ("C", "workday", "x:wd1:s"), ("D", "workday", "x/job/1"), ("E", "what", "e"), ("F", "lever", "")]
    good, bad = registry.validate(spark.createDataFrame(rows, "company string, ats string, slug string"))
    assert {(r.ats, r.slug) for r in good.collect()} == {("greenhouse", "a"), ("workday", "x:wd1:s")}
    assert {r.reason: r.n for r in bad.collect()} == {"ats_mismatch": 1, "malformed_slug": 1, "unsupported_ats": 1, "missing_slug": 1}
    shapes = ['[{"company":"A","ats":"lever","slug":"a"}]', '{"companies":[{"name":"B","ats_type":"ashby","slug":"b"}]}', '{"gem":[{"company":"C","slug":"c"}]}']
    got = registry.read_registry(spark.createDataFrame([(s,) for s in shapes], "payload string")).collect()
    assert {(r.company, r.ats, r.slug) for r in got} == {("A", "lever", "a"), ("B", "ashby", "b"), ("C", "gem", "c")}


def test_cards(spark):
    from pyspark.sql import functions as F

    from spindrift.sources import cards

    today = F.lit("2026-03-05").cast("date")
    page = '<a data-jk="k1"><span title="Data Engineer">x</span></a><span data-testid="company-name">Acme</span><div data-testid="text-location">Austin, TX</div><span class="date">3 days ago</span><a data-jk="k2"><span>Analyst</span></a>'
    got = {r.job_id: r for r in cards.keyed_cards(spark.createDataFrame([(page,)], "html string"), today).collect()}
    assert (got["indeed_k1"].title, got["indeed_k1"].company, got["indeed_k1"].location, got["indeed_k1"].date_posted) == ("Data Engineer", "Acme", "Austin, TX", "2026-03-02")
    assert (got["indeed_k2"].title, got["indeed_k2"].company) == ("Analyst", "Unknown")
    page = '<a href="/companies/big-co/jobs/Ab1-engineer" class="x"><b>Engineer</b></a> Remote (US) <a href="/careers/ml-lead">x</a>'
    df = spark.createDataFrame([(page,)], "html string")
    (r,) = cards.company_links(df).collect()
    assert (r.job_id, r.title, r.company, r.location) == ("yc_Ab1-engineer", "Engineer", "Big Co", "Remote (US)")
    (r,) = cards.slug_links(df, r'href="(/careers/([a-z0-9-]+))"', "https://c.example", "C", "cursor").collect()
    assert (r.job_id, r.title, r.url) == ("ml-lead", "Ml Lead", "https://c.example/careers/ml-lead")
