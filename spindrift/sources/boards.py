"""Landed board payloads to postings: one JSON payload a row, read as variants, exploded and projected.

A board is a declaration: where its list lies and which paths fill each column. Paths are tried in order; the first
that isn't null or blank counts. Paging needs nothing: pages are further payload rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import html_to_text

POSTING = ("job_id", "title", "company", "location", "url", "date_posted", "source_ats", "description")


@dataclass(frozen=True)
class Board:
    """roots: where the list of postings may lie. Columns are paths or functions of the posting's variant and the slug."""

    roots: tuple[str, ...]
    job_id: tuple[str, ...]
    title: tuple[str, ...]
    location: tuple[str, ...] | Callable = ()
    url: tuple[str, ...] | Callable = ()
    posted: tuple[str, ...] | Callable = ()
    description: tuple[str, ...] | Callable = ()
    no_place: str = "Unknown"
    keep: Callable | None = field(default=None)


def at(v: Column, *paths: str) -> Column:
    """The first path that holds a string that isn't blank, or null."""
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths]) if paths else F.lit(None).cast("string")


def items(v: Column, path: str) -> Column:
    """A list of variants, or null where there is none."""
    return F.try_variant_get(v, path, "array<variant>")


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def _names(v: Column, path: str, name: str, n: int | None = None) -> Column:
    names = F.transform(items(v, path), lambda x: at(x, name, "$"))
    names = F.filter(F.slice(names, 1, n) if n else names, lambda x: x.isNotNull() & ~x.startswith("{"))
    return F.nullif(F.array_join(names, ", "), F.lit(""))


def _millis(v: Column, path: str) -> Column:
    return F.date_format(F.timestamp_millis(F.try_variant_get(v, path, "long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _seconds(v: Column, path: str) -> Column:
    n = F.try_variant_get(v, path, "double")
    return F.date_format(F.timestamp_seconds(F.when(n > 1e12, n / 1000).otherwise(n)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _address(pattern: str) -> Callable:
    """An address from the slug and the posting's id."""
    return lambda v, slug, job_id: F.replace(F.replace(F.lit(pattern), F.lit("{slug}"), slug), F.lit("{id}"), F.coalesce(job_id, F.lit("")))


def _lever_text(v: Column, slug: Column, job_id: Column) -> Column:
    lists = F.transform(items(v, "$.lists"), lambda x: F.concat_ws(" ", at(x, "$.text"), html_to_text(at(x, "$.content"))))
    return F.nullif(F.concat_ws(" ", at(v, "$.descriptionPlain"), F.array_join(lists, " "), at(v, "$.additionalPlain")), F.lit(""))


def _sections(v: Column, slug: Column, job_id: Column) -> Column:
    return F.nullif(F.concat_ws(" ", *[html_to_text(at(v, f"$.jobAd.sections.{s}.text")) for s in ("jobDescription", "qualifications", "additionalInformation")]), F.lit(""))


def _workday_posted(v: Column, slug: Column, job_id: Column) -> Column:
    bullets = F.try_variant_get(v, "$.bulletFields", "array<string>")
    return F.coalesce(at(v, "$.postedOn"), F.get(F.filter(bullets, lambda b: F.lower(b).rlike("posted|ago")), 0))


def _oracle_places(v: Column, slug: Column, job_id: Column) -> Column:
    return _joined(at(v, "$.PrimaryLocation"), _names(v, "$.secondaryLocations", "$.Name"))


def _with_id(v: Column) -> Column:
    return at(v, "$.Title").isNotNull() & at(v, "$.Id").isNotNull()


#: The boards' field names and addresses.
BOARDS = {
    "greenhouse": Board(("$.jobs",), ("$.id",), ("$.title",), ("$.location.name",), _address("https://boards.greenhouse.io/{slug}/jobs/{id}"), ("$.updated_at", "$.created_at"), ("$.content",)),
    "lever": Board(("$",), ("$.id",), ("$.text",), lambda v, s, i: F.coalesce(_names(v, "$.categories.location", "$"), at(v, "$.categories.location")), ("$.hostedUrl",), lambda v, s, i: _millis(v, "$.createdAt"), _lever_text),
    "ashby": Board(("$.jobs",), ("$.id",), ("$.title",), ("$.location.name", "$.location"), ("$.jobUrl", "$.applyUrl"), ("$.publishedAt",), ("$.descriptionPlain", "$.descriptionHtml")),
    "smartrecruiters": Board(("$.content",), ("$.id",), ("$.name",), lambda v, s, i: _joined(at(v, "$.location.city"), at(v, "$.location.region"), at(v, "$.location.country")), _address("https://jobs.smartrecruiters.com/{slug}/{id}"), ("$.releasedDate",), _sections),
    "bamboohr": Board(("$.result",), ("$.id",), ("$.jobOpeningName",), lambda v, s, i: _joined(at(v, "$.location.city"), at(v, "$.location.state")), _address("https://{slug}.bamboohr.com/careers/{id}"), ("$.datePosted",), ("$.description",)),
    "workday": Board(("$.jobPostings",), ("$.externalPath", "$.title"), ("$.title",), ("$.locationsText",), lambda v, s, i: F.concat(F.lit("https://"), F.split_part(s, F.lit(":"), F.lit(1)), F.lit("."), F.split_part(s, F.lit(":"), F.lit(2)), F.lit(".myworkdayjobs.com/"), F.split_part(s, F.lit(":"), F.lit(3)), F.coalesce(at(v, "$.externalPath"), F.lit(""))), _workday_posted),
    "workable": Board(("$.results",), ("$.shortcode",), ("$.title",), lambda v, s, i: _joined(at(v, "$.location.city"), at(v, "$.location.region"), at(v, "$.location.country")), _address("https://apply.workable.com/{slug}/j/{id}/"), ("$.published",), ("$.description",)),
    "rippling": Board(("$.jobs", "$.data", "$"), ("$.id",), ("$.name",), ("$.location.name", "$.location"), lambda v, s, i: F.coalesce(at(v, "$.url"), _address("https://ats.rippling.com/{slug}/jobs/{id}")(v, s, i)), ("$.timeCreated",), ("$.description",)),
    "gem": Board(("$.jobs", "$.data", "$"), ("$.id", "$.req_id"), ("$.title", "$.name"), lambda v, s, i: F.coalesce(_joined(at(v, "$.location.city"), at(v, "$.location.state"), at(v, "$.location.country")), at(v, "$.location", "$.city")), lambda v, s, i: F.coalesce(at(v, "$.apply_url", "$.url"), _address("https://job-boards.gem.com/{slug}/jobs/{id}")(v, s, i)), ("$.created_at", "$.posted_at"), ("$.description", "$.content")),
    "oracle": Board(("$.items[0].requisitionList",), ("$.Id",), ("$.Title",), _oracle_places, lambda v, s, i: F.concat(F.lit("https://"), F.split_part(s, F.lit(":"), F.lit(1)), F.lit("/hcmUI/CandidateExperience/en/sites/"), F.split_part(s, F.lit(":"), F.lit(2)), F.lit("/job/"), i), ("$.PostedDate",), (), keep=_with_id),
    "apple": Board(("$.res.searchResults",), ("$.id", "$.positionId"), ("$.postingTitle",), ("$.locations[0].name",), lambda v, s, i: F.concat(F.lit("https://jobs.apple.com/en-us/details/"), F.coalesce(at(v, "$.positionId"), F.lit("")), F.lit("/"), F.coalesce(at(v, "$.transformedPostingTitle"), F.lit(""))), ("$.postingDate",), ("$.jobSummary", "$.description"), no_place="United States"),
    "amazon": Board(("$.searchHits",), ("$.fields.icimsJobId[0]", "$.fields.jobCode[0]"), ("$.fields.title[0]",), ("$.fields.location[0]",), lambda v, s, i: F.coalesce(at(v, "$.fields.urlNextStep[0]"), F.concat(F.lit("https://www.amazon.jobs/en/jobs/"), i)), ("$.fields.createdDate[0]",), lambda v, s, i: F.nullif(F.concat_ws(" ", html_to_text(at(v, "$.fields.description[0]")), html_to_text(at(v, "$.fields.basic_qualifications[0]"))), F.lit("")), no_place="United States"),
    "microsoft": Board(("$.data.positions",), ("$.id",), ("$.name",), ("$.locations[0]",), lambda v, s, i: F.concat(F.lit("https://apply.careers.microsoft.com"), F.coalesce(at(v, "$.positionUrl"), F.lit(""))), lambda v, s, i: _seconds(v, "$.postedTs"), ("$.description",), no_place="United States"),
    "nvidia": Board(("$.data.positions",), ("$.id",), ("$.name",), ("$.locations[0]",), lambda v, s, i: F.concat(F.lit("https://nvidia.eightfold.ai"), F.coalesce(at(v, "$.positionUrl"), F.lit(""))), lambda v, s, i: _seconds(v, "$.postedTs"), ("$.description",), no_place="United States"),
    "tiktok": Board(("$.data.job_post_list",), ("$.id",), ("$.title",), lambda v, s, i: _joined(at(v, "$.city_info.en_name"), at(v, "$.city_info.parent.en_name"), at(v, "$.city_info.parent.parent.en_name")), _address("https://lifeattiktok.com/search/{id}"), (), ("$.description",)),
    "uber": Board(("$.data.results",), ("$.id",), ("$.title",), lambda v, s, i: _joined(at(v, "$.location.city"), at(v, "$.location.region"), at(v, "$.location.countryName")), _address("https://www.uber.com/careers/list/{id}"), ("$.creationDate",), ("$.description",)),
    "tesla": Board(("$.results", "$.listings", "$.jobs"), ("$.id", "$.jobId"), ("$.title", "$.jobTitle"), ("$.location.name", "$.location", "$.city"), _address("https://www.tesla.com/careers/search/job/{id}"), ("$.postedDate",), (), no_place="United States"),
    "meta": Board(("$.data.job_search_with_featured_jobs.all_jobs", "$.data.job_search.jobs", "$.data.job_search.results"), ("$.id",), ("$.title",), lambda v, s, i: _names(v, "$.locations", "$.name"), _address("https://www.metacareers.com/jobs/{id}"), ()),
    "remoteok": Board(("$",), ("$.id", "$.slug"), ("$.position",), ("$.location",), ("$.url",), ("$.date",), ("$.description",), no_place="Remote", keep=lambda v: at(v, "$.slug").isNotNull()),
    "remotive": Board(("$.jobs",), ("$.id",), ("$.title",), ("$.candidate_required_location",), ("$.url",), ("$.publication_date",), ("$.description",), no_place="Remote"),
    "github": Board(("$",), ("$.id",), ("$.title",), lambda v, s, i: _names(v, "$.locations", "$", 3), ("$.url",), lambda v, s, i: _seconds(v, "$.date_posted"), keep=lambda v: F.coalesce(F.try_variant_get(v, "$.active", "boolean"), F.lit(True)) & F.coalesce(F.try_variant_get(v, "$.is_visible", "boolean"), F.lit(True))),
    "hiringcafe": Board(("$.jobs", "$.results", "$"), ("$.id", "$.job_id"), ("$.title", "$.job_title"), ("$.location",), ("$.url", "$.apply_url", "$.link"), ("$.date_posted", "$.posted_date", "$.date")),
    "jobright": Board(("$.jobs", "$.results", "$.data", "$"), ("$.id", "$.job_id"), ("$.title", "$.job_title"), ("$.location",), ("$.url", "$.apply_url"), ("$.date_posted", "$.posted_date")),
    "yc-startup": Board(("$.hits",), ("$.objectID", "$.id"), ("$.title",), lambda v, s, i: F.coalesce(_names(v, "$.pretty_location", "$"), at(v, "$.pretty_location"), _names(v, "$.location", "$"), at(v, "$.location")), lambda v, s, i: F.coalesce(at(v, "$.url"), F.concat(F.lit("https://www.workatastartup.com/jobs/"), at(v, "$.slug"))), ("$.created_at",)),
}
#: Where a posting names its own company.
COMPANY = {"remoteok": ("$.company",), "remotive": ("$.company_name",), "github": ("$.company_name",), "hiringcafe": ("$.company", "$.company_name"), "jobright": ("$.company", "$.company_name"), "yc-startup": ("$.company_name", "$.startup_name")}


def read_board(payloads: DataFrame, platform: str, registry: dict[str, Board] = BOARDS) -> DataFrame:
    """Postings of payload rows (company, slug, payload); payloads that aren't JSON give none."""
    board = registry[platform]
    v = F.try_parse_json("payload")
    listed = payloads.select("company", "slug", v.alias("v")).where(F.col("v").isNotNull())
    listed = listed.select("company", "slug", F.explode(F.coalesce(*[items(F.col("v"), r) for r in board.roots])).alias("j"))
    j, slug = F.col("j"), F.coalesce("slug", F.lit(""))
    if board.keep:
        listed = listed.where(board.keep(j))
    job_id = at(j, *board.job_id)

    def fill(spec: tuple[str, ...] | Callable) -> Column:
        return spec(j, slug, job_id) if callable(spec) else at(j, *spec)

    company = F.coalesce(at(j, *COMPANY[platform]), F.col("company")) if platform in COMPANY else F.col("company")
    text = fill(board.description)
    return listed.select(
        job_id.alias("job_id"),
        F.coalesce(at(j, *board.title), F.lit("")).alias("title"),
        company.alias("company"),
        F.coalesce(fill(board.location), F.lit(board.no_place)).alias("location"),
        F.coalesce(fill(board.url), F.lit("")).alias("url"),
        F.coalesce(fill(board.posted), F.lit("")).alias("date_posted"),
        F.lit(platform).alias("source_ats"),
        F.nullif(html_to_text(text), F.lit("")).alias("description"),
    )


def read_all(payloads: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """Postings of payload rows (platform, company, slug, payload) of every known board, in one union."""
    out = None
    for platform in platforms or BOARDS:
        part = read_board(payloads.where(F.col("platform") == platform), platform)
        out = part if out is None else out.unionByName(part)
    return out


def repair_aliases(targets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Targets with the slug an alias table (ats, company, slug, new_slug) gives; a small dimension table."""
    keyed = aliases.select("ats", "company", "slug", "new_slug")
    return targets.join(keyed, ["ats", "company", "slug"], "left").withColumn("slug", F.coalesce("new_slug", "slug")).drop("new_slug")
