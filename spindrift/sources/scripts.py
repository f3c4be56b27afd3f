"""Objects in script text, and pages that hold postings in several ways: structured data, cards, the page's own payload."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import html_to_text
from spindrift.sources.boards import POSTING

_MARKS = re.compile(r'["{}\\]')


def balanced_objects(text: str, at: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of the outermost {...} from a place on; braces in double-quoted strings don't count, an object that never closes ends the scan."""
    depth, start, quoted = 0, 0, False
    while m := _MARKS.search(text, at):
        at, mark = m.end(), m[0]
        if mark == "\\":
            at += quoted  # an escaped character
        elif mark == '"':
            quoted = not quoted if depth else False  # quotes outside of objects belong to the script
        elif not quoted and mark == "{":
            start, depth = (start if depth else m.start()), depth + 1
        elif not quoted and depth:
            depth -= 1
            if not depth:
                yield start, at


def object_after(text: str, anchor: str) -> object | None:
    """The first object behind an anchor that reads as JSON, such as a value assigned to a name in a script."""
    found = text.find(anchor)
    if found < 0:
        return None
    for start, end in balanced_objects(text, found + len(anchor)):
        try:
            return json.loads(text[start:end])
        except ValueError:
            continue
    return None


#: Where the page keeps its postings, what a card's link, company and place look like, and how far around the link they stand.
LD_SCRIPT = re.compile(r"<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.S | re.I)
PAYLOAD_SCRIPT = re.compile(r"<script[^>]+id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", re.S | re.I)
CARD = re.compile(r'<a[^>]+href="(/jobs/(\d+))"[^>]*>\s*(.*?)\s*</a>', re.S | re.I)
CARD_COMPANY = re.compile(r"data-company(?:-name)?=[\"']([^\"']+)[\"']|class=[\"'][^\"']*company[^\"']*[\"'][^>]*>\s*([^<]{1,80})<", re.I)
CARD_PLACE = re.compile(r"class=[\"'][^\"']*location[^\"']*[\"'][^>]*>\s*([^<]{1,80})<|data-location=[\"']([^\"']+)[\"']", re.I)
AROUND, SITE, JOBS_PATH, NO_COMPANY = 600, "https://www.workatastartup.com", "/jobs", "YC Startup"

FIELDS = ("job_id", "title", "company", "location", "url", "date_posted", "description")


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value)


def _structured(html: str) -> Iterator[dict]:
    """The first structured block, if it is a posting of a named company."""
    m = LD_SCRIPT.search(html)
    try:
        data = json.loads(m[1]) if m else None
    except ValueError:
        return
    data = data[0] if isinstance(data, list) and data else data
    if not isinstance(data, dict) or data.get("@type") != "JobPosting":
        return
    company, place = data.get("hiringOrganization"), data.get("jobLocation")
    address = place.get("address") if isinstance(place, dict) else None
    address = address if isinstance(address, dict) else {}
    row = {"title": _text(data.get("title")), "company": _text(company.get("name")) if isinstance(company, dict) else "", "location": _text(address.get("addressLocality") or address.get("addressRegion")), "url": _text(data.get("url")) or SITE + JOBS_PATH, "date_posted": _text(data.get("datePosted")), "description": _text(data.get("description"))}
    if row["title"] and row["company"]:
        yield row


def _cards(html: str) -> Iterator[dict]:
    """Links to numbered postings, company and place by what stands near each."""
    for m in CARD.finditer(html):
        near = html[max(0, m.start() - AROUND) : m.end() + AROUND]
        company, place = CARD_COMPANY.search(near), CARD_PLACE.search(near)
        yield {"title": m[3], "company": next(filter(None, company.groups()), "") if company else "", "location": next(filter(None, place.groups()), "") if place else "", "url": SITE + m[1], "date_posted": "", "description": "", "card": m[2]}


def _payload(html: str) -> Iterator[dict]:
    """The postings in the page's own payload."""
    m = PAYLOAD_SCRIPT.search(html)
    data = object_after(m[1], "") if m else None
    props = data.get("props") if isinstance(data, dict) else None
    page = props.get("pageProps") if isinstance(props, dict) else None
    listed = page.get("jobs", page.get("jobListings", [])) if isinstance(page, dict) else []
    for job in listed if isinstance(listed, list) else []:
        if not isinstance(job, dict) or not (job.get("title") or job.get("job_title")):
            continue
        company, number = job.get("company") or {}, _text(job.get("id") or job.get("job_id"))
        name = (company.get("name") or company.get("company_name")) if isinstance(company, dict) else company
        yield {"title": _text(job.get("title") or job.get("job_title")), "company": _text(name), "location": _text(job.get("location") or job.get("remote_ok") or "Remote"), "url": _text(job.get("url")) or SITE + JOBS_PATH + (f"/{number}" if number else ""), "date_posted": _text(job.get("created_at") or job.get("date_posted")), "description": _text(job.get("description") or job.get("body"))}


def _found(html: str) -> list[dict]:
    rows, seen = list(_structured(html)), set()
    for card in _cards(html):
        title = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", card["title"])).strip()
        if 3 <= len(title) <= 120 and card["card"] not in seen:
            seen.add(card.pop("card"))
            rows.append(card)
    return rows or list(_payload(html))


def startup_postings(pages: DataFrame, html: str = "html") -> DataFrame:
    """Postings of start-up pages: the structured block and the cards; where there is neither, the page's own payload.

    Damaged blocks and payloads are passed over. Null and empty pages give nothing; one posting a job id stays.
    """
    kind = pa.list_(pa.struct([(f, pa.string()) for f in FIELDS[1:]]))

    @F.arrow_udf(f"array<struct<{', '.join(f'{f}:string' for f in FIELDS[1:])}>>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([[{f: r[f] for f in FIELDS[1:]} for r in _found(t)] if t else [] for t in part.to_pylist()], kind)

    # Pages that can't hold any never reach Python.
    likely = F.col(html).contains("/jobs/") | F.col(html).contains("ld+json") | F.col(html).contains("__NEXT_DATA__")
    rows = pages.where(likely).select(F.inline(found(html)))
    rows = rows.select(*[html_to_text(F.col(f)).alias(f) if f in ("title", "company", "location", "description") else F.col(f) for f in FIELDS[1:]])
    number = F.regexp_extract("url", r"/jobs/(\d+)", 1)
    hashed = F.substring(F.sha2(F.concat(F.lower("company"), F.lit("|"), F.lower("title")), 256), 1, 12)
    company = F.when(F.col("company") == "", NO_COMPANY).otherwise(F.col("company"))
    rows = rows.withColumn("company", company).withColumn("job_id", F.concat(F.lit("yc_"), F.when(number != "", number).otherwise(hashed)))
    place = F.when((F.col("location") == "") | F.col("location").rlike(r"(?i)\bremote\b"), "Remote").otherwise(F.col("location"))
    base = {c: F.lit("") for c in POSTING} | {f: F.col(f) for f in FIELDS} | {"location": place, "source_ats": F.lit("ycombinator")}
    return rows.select(*[v.alias(c) for c, v in base.items()]).where(F.col("title") != "").dropDuplicates(["job_id"])


def objects_in(text: Column, anchor: str) -> Column:
    """As JSON text the first whole object behind an anchor in each text, or null."""

    @F.arrow_udf("string")
    def read(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            found = [object_after(t, anchor) if t else None for t in part.to_pylist()]
            yield pa.array([None if f is None else json.dumps(f, ensure_ascii=False, sort_keys=True) for f in found], pa.string())

    return F.when(text.contains(anchor), read(text))
