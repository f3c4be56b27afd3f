"""Job cards and links in landed HTML, by patterns; no browser and no selector engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import html_to_text
from spindrift.sources.boards import POSTING


def relative_day(text: Column, today: Column) -> Column:
    """A date from today, yesterday, just posted, N days (or 30+ days) ago; null for anything else."""
    t = F.lower(F.coalesce(text, F.lit("")))
    days = F.regexp_extract(t, r"(\d+)\+?\s*day", 1).try_cast("int")
    return F.when(t.rlike("today|just posted|hour|minute"), today).when(t.contains("yesterday"), F.date_sub(today, 1)).when(days.isNotNull(), F.date_sub(today, days))


def _posting(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    base = {c: F.lit("") for c in POSTING} | {"location": F.lit("Unknown"), "company": F.lit("Unknown"), "source_ats": F.lit(source), "description": F.lit(None).cast("string")}
    return rows.select(*[v.alias(c) for c, v in (base | columns).items()]).where(F.col("title") != "").dropDuplicates(["job_id"])


def keyed_cards(pages: DataFrame, today: Column, html: str = "html") -> DataFrame:
    """Postings of result pages whose cards carry a data-jk key, with title, company, place and age in marked elements."""
    parts = F.split(html, 'data-jk="')
    cards = pages.select(F.explode(F.slice(parts, 2, F.size(parts))).alias("card"))
    c = F.col("card")

    def marked(mark: str) -> Column:
        return html_to_text(F.regexp_extract(c, rf'(?s){mark}"[^>]*>(.*?)</', 1))

    key = F.regexp_extract(c, r'^([^"]+)"', 1)
    title = F.coalesce(F.nullif(F.regexp_extract(c, r'<span[^>]*\btitle="([^"]+)"', 1), F.lit("")), html_to_text(F.regexp_extract(c, r"(?s)<span[^>]*>(.*?)</span>", 1)))
    posted = F.coalesce(relative_day(marked("date"), today).cast("string"), F.lit(""))
    return _posting(cards, "indeed", job_id=F.concat(F.lit("indeed_"), key), title=title, company=F.coalesce(F.nullif(marked("company-name"), F.lit("")), F.lit("Unknown")), location=F.coalesce(F.nullif(marked("text-location"), F.lit("")), F.lit("Unknown")), url=F.concat(F.lit("https://www.indeed.com/viewjob?jk="), key), date_posted=posted)


def company_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Postings behind links of the form /companies/NAME/jobs/ID-title: the company from the path, the title from the link's text, the place near it."""
    link = r'(?s)href="(/companies/[^/"]+/jobs/[^"]+)"[^>]*>(.*?)</a>'
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("path"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("label"))
    rows = pages.select(html, F.explode(found).alias("x")).select(F.col(html).alias("page"), F.col("x.path").alias("path"), html_to_text(F.col("x.label")).alias("label"))
    near = F.substring("page", F.instr("page", F.col("path")), F.lit(600))
    place = F.trim(F.regexp_extract(near, r"(Remote[^<]{0,40}|[A-Z][A-Za-z .]+, [A-Z]{2}\b)", 1))
    company = F.initcap(F.replace(F.split_part("path", F.lit("/"), F.lit(3)), F.lit("-"), F.lit(" ")))
    ident = F.regexp_extract("path", r"/jobs/([^/?]+)", 1)
    return _posting(rows, "ycombinator", job_id=F.concat(F.lit("yc_"), ident), title=F.col("label"), company=company, location=F.coalesce(F.nullif(place, F.lit("")), F.lit("Unknown")), url=F.concat(F.lit("https://www.ycombinator.com"), F.col("path")))


def slug_links(pages: DataFrame, pattern: str, site: str, company: str, source: str, html: str = "html") -> DataFrame:
    """Postings behind links that only carry a slug; pattern captures the path and the slug, the slug becomes the title."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("path"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("slug"))
    rows = pages.select(F.explode(found).alias("x")).select("x.path", "x.slug").distinct()
    return _posting(rows, source, job_id=F.col("slug"), title=F.initcap(F.replace("slug", F.lit("-"), F.lit(" "))), company=F.lit(company), url=F.concat(F.lit(site), F.col("path")))
