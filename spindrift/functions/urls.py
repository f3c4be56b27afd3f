"""Address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import bound


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)


def without_tracking(url: Column) -> Column:
    """Without utm_ parameters; a question mark left alone goes too."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


#: Hosts of boards, where in the path or host the company stands.
PLATFORM_HOSTS = (
    ("greenhouse", "greenhouse.io", r"://[^/]+/(?:embed/job_board\?for=)?([^/?#&]+)"),
    ("lever", "lever.co", r"://[^/]+/([^/?#]+)"),
    ("ashby", "ashbyhq.com", r"://[^/]+/([^/?#]+)"),
    ("workable", "workable.com", r"://[^/]+/([^/?#]+)"),
    ("rippling", "rippling.com", r"://[^/]+/([^/?#]+)"),
    ("smartrecruiters", "smartrecruiters.com", r"://[^/]+/([^/?#]+)"),
    ("gem", "gem.com", r"://[^/]+/([^/?#]+)"),
    ("bamboohr", "bamboohr.com", r"://([^./]+)\."),
    ("workday", "myworkdayjobs.com", r"://([^./]+)\."),
    ("icims", "icims.com", r"://([^./]+)\."),
    ("oracle", "oraclecloud.com", r"://([^./]+)\."),
)


def platform(url: Column) -> Column:
    """The board a host belongs to, or null."""
    return bound(host(url), lambda h: F.coalesce(*[F.when((h == suffix) | h.endswith(f".{suffix}"), F.lit(name)) for name, suffix, _ in PLATFORM_HOSTS]))


def target(url: Column) -> Column:
    """(platform, slug) of a board address; both null elsewhere. Workday slugs are tenant:shard:site."""

    def named(p: Column) -> Column:
        slug = F.coalesce(*[F.when(p == name, F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))) for name, _, pattern in PLATFORM_HOSTS if name != "workday"])
        parts = (r"://([^./]+)\.", r"://[^./]+\.(wd\d+)\.", r"://[^/]+/(?:[a-z]{2}-[A-Z]{2}/)?([^/?#]+)")
        workday = F.array_join(F.filter(F.array(*[F.regexp_extract(url, r, 1) for r in parts]), lambda x: x != ""), ":")
        return F.struct(p.alias("platform"), F.when(p == "workday", workday).otherwise(slug).alias("slug"))

    return bound(platform(url), named)


#: What in a page's text shows the board it embeds, and where the company stands, if it does.
CONTENT = (
    ("greenhouse", (r"greenhouse\.io/embed/job_board/(?:js/)?(\w+)", r'data-greenhouse-board="(\w+)"')),
    ("lever", (r"jobs\.lever\.co/([\w-]+)", r"api\.lever\.co/v0/postings/([\w-]+)")),
    ("workable", (r"apply\.workable\.com/([\w-]+)", r"workable\.com/widget/job_board()")),
    ("ashby", (r"jobs\.ashbyhq\.com/([\w-]+)",)),
    ("workday", (r"myworkdayjobs\.com()",)),
    ("rippling", (r"ats\.rippling\.com/([\w-]+)",)),
    ("smartrecruiters", (r"smartrecruiters\.com()",)),
)


def page_target(html: Column) -> Column:
    """(platform, slug) of the board that a page embeds, by the first pattern of the list that its text holds; both null without one, slug null where the pattern shows none."""
    found = [F.when(html.rlike(p), F.struct(F.lit(name).alias("platform"), F.nullif(F.regexp_extract(html, p, 1), F.lit("")).alias("slug"))) for name, patterns in CONTENT for p in patterns]
    none = F.struct(F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("slug"))
    return F.coalesce(*found, none)


def links(text: Column) -> Column:
    """Distinct addresses in a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s\"'<>)\]]+"), F.lit(0)))


#: Where the company stands in addresses that searches find, by board, and names that are no company's.
DISCOVERY = {
    "greenhouse": (r"boards\.greenhouse\.io/(\w+)", r"boards-api\.greenhouse\.io/v1/boards/(\w+)", r"job-boards\.greenhouse\.io/(\w+)"),
    "lever": (r"jobs\.lever\.co/([\w-]+)",),
    "ashby": (r"jobs\.ashbyhq\.com/([\w-]+)",),
    "workable": (r"apply\.workable\.com/([\w-]+)",),
    "rippling": (r"ats\.rippling\.com/([\w-]+)",),
    "smartrecruiters": (r"jobs\.smartrecruiters\.com/([\w-]+)",),
    "bamboohr": (r"([\w-]+)\.bamboohr\.com",),
    "workday": (r"([\w-]+)\.myworkdayjobs\.com", r"([\w-]+)\.wd\d+\.myworkdayjobs\.com"),
    "gem": (r"job-boards\.gem\.com/([\w-]+)",),
}
RESERVED = ("embed", "api", "v1", "v0", "jobs", "careers", "www")


def discovered(url: Column, ats: Column) -> Column:
    """The company's name in an address of a board: the first pattern of the board whose match is not a reserved name, or null."""

    def found(pattern: str) -> Column:
        name = F.lower(F.regexp_extract(url, f"(?iU){pattern}", 1))
        return F.when((name != "") & ~name.isin(*RESERVED), name)

    return F.coalesce(*[F.when(ats == board, F.coalesce(*map(found, patterns))) for board, patterns in DISCOVERY.items()])
