"""Pages, feeds and listings to postings: JSON-LD, sitemaps, feeds, comment threads, markdown tables, link lists."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.text import bound, html_to_text, slugify
from spindrift.sources.boards import POSTING, at

LD_SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
#: Keys that wrap postings, and how many nodes a page may have.
WRAPPERS = ("@graph", "itemListElement", "item", "mainEntity")
MOST_NODES = 10_000


def _blocks(scripts: list[str]) -> Iterator[object]:
    decoder = json.JSONDecoder()
    for raw in scripts:
        raw = raw.strip()
        try:
            yield json.loads(raw)
        except ValueError:
            try:  # the first whole object of a damaged block
                yield decoder.raw_decode(raw[raw.index("{") :])[0]
            except ValueError:
                continue


def _postings(scripts: list[str]) -> list[str]:
    todo, found, seen = list(_blocks(scripts)), [], 0
    while todo and seen < MOST_NODES:
        node, seen = todo.pop(), seen + 1
        if isinstance(node, list):
            todo += node
        elif isinstance(node, dict):
            kinds = node.get("@type")
            if any(isinstance(k, str) and k.lower() == "jobposting" for k in (kinds if isinstance(kinds, list) else [kinds])):
                found.append(json.dumps(node))
            else:
                todo += [node[k] for k in WRAPPERS if k in node]
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _find_postings(scripts: pd.Series) -> pd.Series:
    return scripts.map(lambda s: _postings(list(s)) if s is not None else [])


def json_ld(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Postings and salaries in pages' JSON-LD; pages without a script never reach Python. Rows without a title are dropped."""
    scripts = pages.where(F.col(html).contains("ld+json")).select(F.col(url).alias("page_url"), F.regexp_extract_all(html, F.lit(LD_SCRIPT), F.lit(1)).alias("scripts"))
    j = F.col("j")
    nodes = scripts.select("page_url", F.explode(_find_postings("scripts")).alias("node")).select("page_url", F.try_parse_json("node").alias("j"))
    place = "$.jobLocation"
    parts = []
    for field in ("addressLocality", "addressRegion", "addressCountry"):
        paths = [f"{p}.address{a}.{field}{n}" for n in (".name", "") for p in (place, f"{place}[0]") for a in ("", "[0]")]
        value = at(j, *paths)
        parts.append(F.when(~value.startswith("{"), value))
    whole = F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), ", ")
    plain = at(j, f"{place}.address", f"{place}[0].address")
    location = F.coalesce(F.nullif(whole, F.lit("")), F.when(~plain.startswith("{") & ~plain.startswith("["), plain), F.when(F.upper(F.coalesce(at(j, "$.jobLocationType"), F.lit(""))).contains("TELECOMMUTE"), "Remote"), F.lit("Unknown"))
    number = lambda *paths: F.replace(at(j, *paths), F.lit(","), F.lit("")).try_cast("double")
    base = ("$.baseSalary", "$.baseSalary[0]")
    single = number(*[f"{b}.value{v}" for b in base for v in (".value", "[0].value", "")])
    low, high = (number(*[f"{b}.value{v}.{k}" for b in base for v in ("", "[0]")]) for k in ("minValue", "maxValue"))
    one = F.when(low.isNull() & high.isNull(), single)
    address = F.coalesce(at(j, "$.url[0]", "$.url", "$.hiringOrganizationUrl"), F.col("page_url"))
    ident = at(j, "$.identifier[0].value", "$.identifier.value", "$.identifier[0]", "$.identifier")
    return (
        nodes.where(at(j, "$.title").isNotNull())
        .select(
            F.coalesce(F.when(~ident.startswith("{"), ident), address, F.substring(at(j, "$.title"), 1, 80)).alias("job_id"),
            at(j, "$.title").alias("title"),
            F.coalesce(at(j, "$.hiringOrganization[0].name", "$.hiringOrganization.name"), F.when(~at(j, "$.hiringOrganization").startswith("{"), at(j, "$.hiringOrganization")), F.lit("Unknown")).alias("company"),
            location.alias("location"),
            address.alias("url"),
            F.coalesce(at(j, "$.datePosted"), F.lit("")).alias("date_posted"),
            F.lit("jsonld").alias("source_ats"),
            at(j, "$.description").alias("description"),
            F.coalesce(low, one).alias("salary_min"),
            F.coalesce(high, one).alias("salary_max"),
            at(j, "$.baseSalary.currency", "$.baseSalary[0].currency", "$.baseSalary.salaryCurrency").alias("salary_currency"),
        )
    )


def is_sitemap(text: Column) -> Column:
    return F.substring(text, 1, 2000).rlike("(?i)<(urlset|sitemapindex)")


def sitemap_urls(pages: DataFrame, text: str = "html", most: int | None = None) -> DataFrame:
    """(url) listed in sitemaps; most bounds those of one sitemap, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return pages.where(is_sitemap(F.col(text))).select(F.explode(F.slice(found, 1, most) if most else found).alias("url"))


def rss(items: DataFrame, source: str) -> DataFrame:
    """Postings of feed items (title, link, pubDate, description), as Spark's XML reader gives them with rowTag item; titles read Company: Title."""
    halves = F.split("title", ": ", 2)
    named = F.size(halves) == 2
    return items.select(
        F.col("link").alias("job_id"), F.when(named, halves[1]).otherwise(F.col("title")).alias("title"), F.when(named, halves[0]).otherwise("Unknown").alias("company"), F.lit("Remote").alias("location"), F.col("link").alias("url"), F.coalesce("pubDate", F.lit("")).alias("date_posted"), F.lit(source).alias("source_ats"), F.nullif(html_to_text(F.col("description")), F.lit("")).alias("description")
    ).select(*POSTING)


def read_rss(spark, path: str, source: str) -> DataFrame:
    schema = "title string, link string, pubDate string, description string"
    return rss(spark.read.format("xml").option("rowTag", "item").schema(schema).load(path), source)


def hiring_line(line: Column) -> Column:
    """(company, title) of a thread comment's first line, by the first of five forms that it has.

    Company | Title | ..., Company - Title (any dash), Title at Company, Company: anything (no title), else the line's
    first 80 characters as the company. Null lines are empty.
    """

    def read(t: Column) -> Column:
        parts = F.transform(F.split(t, r"\|"), lambda x: F.trim(x))
        dash, at, colon = r"^(.+?)\s+[-—–]\s+(.+)$", r"(?i)^(.+?)\s+at\s+(.+)$", r"^([^:]{2,60}):\s+(.+)$"

        def both(company: Column, title: Column) -> Column:
            return F.struct(F.trim(company).alias("company"), F.trim(title).alias("title"))

        return (
            F.when(t.contains("|"), both(parts[0], parts[1]))
            .when(t.rlike(dash), both(F.regexp_extract(t, dash, 1), F.regexp_extract(t, dash, 2)))
            .when(t.rlike(at), both(F.regexp_extract(t, at, 2), F.regexp_extract(t, at, 1)))
            .when(t.rlike(colon), both(F.regexp_extract(t, colon, 1), F.lit("")))
            .otherwise(both(F.substring(t, 1, 80), F.lit("")))
        )

    return bound(F.trim(F.coalesce(line, F.lit(""))), read)


def thread_comments(comments: DataFrame) -> DataFrame:
    """Postings of thread comments (id, html, created): the first line reads Company | Title | Location ...; one a company and month."""
    first = html_to_text(F.get(F.split("html", r"(?i)<p>|\n"), 0))
    parts = F.transform(F.split(first, r"\s*\|\s*"), lambda x: F.trim(x))
    parts = F.filter(parts, lambda x: x != "")
    dashed = F.regexp_extract(first, r"^(.+?)\s+(?:is hiring|[-–—])\s+(.+)$", 1)
    company = F.when(F.size(parts) > 1, parts[0]).otherwise(F.nullif(dashed, F.lit("")))
    where = F.get(F.filter(parts, lambda x: x.rlike(r"(?i)remote|onsite|hybrid|\b[A-Z][a-z]+, ?[A-Z]{2}\b")), 0)
    title = F.coalesce(F.get(F.filter(F.slice(parts, 2, 10), lambda x: x.rlike(r"(?i)engineer|developer|scientist|analyst|manager|designer|lead")), 0), F.get(parts, 1), F.nullif(F.regexp_extract(first, r"^(.+?)\s+(?:is hiring|[-–—])\s+(.+)$", 2), F.lit("")))
    link = F.get(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1)), 0)
    rows = comments.where(company.isNotNull()).select(
        F.concat(F.lit("hn_"), slugify(company), F.lit("_"), F.date_format("created", "yyyy-MM")).alias("job_id"), F.coalesce(title, F.lit("Multiple roles")).alias("title"), company.alias("company"), F.coalesce(where, F.lit("Unknown")).alias("location"), F.coalesce(link, F.lit("")).alias("url"), F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_posted"), F.lit("hackernews").alias("source_ats"), html_to_text(F.col("html")).alias("description"), "id"
    )
    order = F.row_number().over(Window.partitionBy("job_id").orderBy("id"))
    return rows.withColumn("_n", order).where("_n = 1").select(*POSTING)


def markdown_rows(files: DataFrame, label: str) -> DataFrame:
    """Postings of markdown tables (path, text), a file a row.

    A header names company, role or position, location, link and date; it holds until the next one. Separators, closed
    and struck rows are dropped; an arrow stands for the company above; links are markdown, HTML or bare. Lines are
    exploded with their position; headers and companies are carried down by windows over a file.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    lower = F.transform(cells, lambda x: F.lower(x))
    rows = lines.select("path", "pos", "line", cells.alias("cells"), lower.alias("lower"))
    is_header = F.exists("lower", lambda x: x.rlike("company|employer")) & F.exists("lower", lambda x: x.rlike("role|position|title|job"))

    def place(pattern: str) -> Column:
        return F.array_position(F.transform("lower", lambda x: x.rlike(pattern)), True).cast("int")

    head = F.when(is_header, F.struct(place("company|employer").alias("company"), place("role|position|title|job").alias("title"), place("location").alias("location"), place("link|apply|url|application").alias("link"), place("date|posted|age").alias("posted")))
    down = Window.partitionBy("path").orderBy("pos")
    rows = rows.withColumn("h", F.last(head, ignorenulls=True).over(down)).where(F.col("h").isNotNull() & ~is_header & ~F.col("line").rlike(r"^[\s|:-]+$"))
    rows = rows.where(~F.col("line").rlike("🔒|~~|(?i)closed"))
    cell = lambda name: F.when(F.col(f"h.{name}") > 0, F.get("cells", F.col(f"h.{name}") - 1))
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1"), "<[^>]+>", " "), r"[*_`]", ""))
    own = bare(cell("company"))
    named = F.last(F.when(~own.isin("↳", "") & own.isNotNull(), own), ignorenulls=True).over(down)
    both = F.concat_ws(" ", cell("link"), cell("title"), F.col("line"))
    link = F.coalesce(*[F.nullif(F.regexp_extract(both, p, 1), F.lit("")) for p in (r"\]\((https?://[^)\s]+)\)", r'href="(https?://[^"]+)"', r"(https?://[^\s|)\"]+)")])
    return rows.select(F.coalesce(link, F.concat_ws("#", "path", "pos")).alias("job_id"), bare(cell("title")).alias("title"), named.alias("company"), F.coalesce(F.nullif(bare(cell("location")), F.lit("")), F.lit("Unknown")).alias("location"), F.coalesce(link, F.lit("")).alias("url"), F.coalesce(bare(cell("posted")), F.lit("")).alias("date_posted"), F.lit(label).alias("source_ats"), F.lit(None).cast("string").alias("description")).where((F.col("title") != "") & F.col("company").isNotNull())


def search_results(results: DataFrame) -> DataFrame:
    """Postings of web-search results (title, url, description): Title - Company - Place or Title at Company, without a site's name behind a bar."""
    clean = F.trim(F.regexp_replace("title", r"\s*[|·]\s*[^|·]*$", ""))
    parts = F.split(clean, r"\s+[-–—]\s+")
    pair = F.regexp_extract(clean, r"^(.+?)\s+at\s+(.+)$", 1)
    at_company = F.regexp_extract(clean, r"^(.+?)\s+at\s+(.+)$", 2)
    title = F.when(F.size(parts) > 1, parts[0]).when(pair != "", pair).otherwise(clean)
    company = F.when(F.size(parts) > 1, parts[1]).when(pair != "", at_company).otherwise("Unknown")
    return results.select(F.col("url").alias("job_id"), title.alias("title"), company.alias("company"), F.coalesce(F.get(parts, 2), F.lit("Unknown")).alias("location"), "url", F.lit("").alias("date_posted"), F.lit("search").alias("source_ats"), F.col("description"))


def google_callback(pages: DataFrame) -> DataFrame:
    """Postings in a page's callback array, read by position: id, title, link, company, places."""
    payload = F.regexp_extract("html", r"(?s)AF_initDataCallback\(\{key:\s*'ds:1'.*?data:\s*(\[.*?\]),\s*sideChannel", 1)
    rows = pages.select(F.try_parse_json(F.nullif(payload, F.lit(""))).alias("v")).where(F.col("v").isNotNull())
    j = F.col("j")
    rows = rows.select(F.explode(F.try_variant_get("v", "$[0]", "array<variant>")).alias("j"))
    places = F.array_join(F.filter(F.transform(F.try_variant_get(j, "$[9]", "array<variant>"), lambda x: at(x, "$[0]")), lambda x: x.isNotNull()), "; ")
    return rows.select(at(j, "$[0]").alias("job_id"), at(j, "$[1]").alias("title"), F.coalesce(at(j, "$[7]"), F.lit("Google")).alias("company"), F.coalesce(F.nullif(places, F.lit("")), F.lit("United States")).alias("location"), F.coalesce(at(j, "$[2]"), F.lit("")).alias("url"), F.lit("").alias("date_posted"), F.lit("google").alias("source_ats"), F.lit(None).cast("string").alias("description")).where(F.col("title").isNotNull())


def crawl_index_urls(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct addresses of crawl-index lines; lines that aren't JSON objects are skipped."""
    v = F.try_parse_json(F.trim(value))
    return lines.where(F.trim(value).startswith("{")).select(at(v, "$.url").alias("url")).where(F.col("url").isNotNull()).distinct()
