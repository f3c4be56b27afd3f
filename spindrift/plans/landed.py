"""Registered queries of source readers over payloads that Spark builds from the tables, with equal SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import urls
from spindrift.plans.catalog import query
from spindrift.sources import boards, pages, registry, scripts

_PLATFORMS = ("greenhouse", "lever", "smartrecruiters", "hiringcafe", "yc-startup")


def _payloads(read) -> DataFrame:
    """A payload a customer, in the shape of one of five boards, with the customer's orders as postings."""
    o = read("orders").join(read("customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string")
    title, place = F.col("o_orderpriority"), F.col("c_mktsegment")
    shapes = {
        "greenhouse": F.struct(key.alias("id"), title.alias("title"), day.alias("updated_at"), F.struct(place.alias("name")).alias("location"), F.concat(F.lit("&lt;p&gt;"), title, F.lit("&amp;amp; more&lt;/p&gt;")).alias("content")),
        "lever": F.struct(key.alias("id"), title.alias("text"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("createdAt"), F.struct(F.array(place, F.lit("Remote")).alias("location")).alias("categories"), F.concat(F.lit("https://l/"), key).alias("hostedUrl"), title.alias("descriptionPlain")),
        "smartrecruiters": F.struct(key.alias("id"), title.alias("name"), day.alias("releasedDate"), F.struct(place.alias("city"), F.lit("").alias("region"), F.lit("us").alias("country")).alias("location")),
        "hiringcafe": F.struct(key.alias("job_id"), title.alias("job_title"), F.col("c_name").alias("company_name"), place.alias("location"), F.concat(F.lit("https://h/"), key).alias("link"), day.alias("posted_date")),
        "yc-startup": F.struct(key.alias("objectID"), title.alias("title"), F.col("c_name").alias("startup_name"), F.array(place, F.lit("SF")).alias("location"), key.alias("slug"), day.alias("created_at")),
    }
    roots = {"greenhouse": "jobs", "smartrecruiters": "content", "hiringcafe": "results", "yc-startup": "hits"}
    out = None
    for i, (name, shape) in enumerate(shapes.items()):
        listed = o.where(F.col("c_custkey") % 5 == i).groupBy("c_custkey").agg(F.collect_list(shape).alias("list"))
        payload = F.to_json(F.struct(F.col("list").alias(roots[name])) if name in roots else F.col("list"))
        part = listed.select(F.lit(name).alias("platform"), F.concat(F.lit("c"), "c_custkey").alias("company"), F.concat(F.lit("s"), "c_custkey").alias("slug"), payload.alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT o_orderkey::VARCHAR AS job_id, o_orderpriority AS title, CASE WHEN k IN (3, 4) THEN c_name ELSE 'c' || c_custkey END AS company,
CASE k WHEN 1 THEN c_mktsegment || ', Remote' WHEN 2 THEN c_mktsegment || ', us' WHEN 4 THEN c_mktsegment || ', SF' ELSE c_mktsegment END AS location,
CASE k WHEN 0 THEN 'https://boards.greenhouse.io/s' || c_custkey || '/jobs/' || o_orderkey WHEN 1 THEN 'https://l/' || o_orderkey WHEN 2 THEN 'https://jobs.smartrecruiters.com/s' || c_custkey || '/' || o_orderkey WHEN 3 THEN 'https://h/' || o_orderkey
ELSE 'https://www.workatastartup.com/jobs/' || o_orderkey END AS url,
CASE k WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_posted,
CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'smartrecruiters' WHEN 3 THEN 'hiringcafe' ELSE 'yc-startup' END AS source_ats,
CASE k WHEN 0 THEN o_orderpriority || '&amp; more' WHEN 1 THEN o_orderpriority END AS description
FROM (SELECT *, c_custkey % 5 AS k FROM orders JOIN customer ON o_custkey = c_custkey)
""")
def board_postings(read):
    return boards.read_all(_payloads(read), list(_PLATFORMS))


_REGISTRY = """
SELECT p_name AS company, CASE p_size % 3 WHEN 0 THEN 'lever' ELSE 'workday' END AS ats, CASE p_size % 4 WHEN 0 THEN 'x/job/1' ELSE replace(lower(p_brand), '#', '') || ':' || p_size || ':' || CASE p_size % 4 WHEN 1 THEN 'Careers/job/7' WHEN 2 THEN 'Careers?q=1' ELSE 'Careers' END END AS slug FROM part
"""


def _registry(read) -> DataFrame:
    site = F.when(F.col("p_size") % 4 == 1, "Careers/job/7").when(F.col("p_size") % 4 == 2, "Careers?q=1").otherwise("Careers")
    slug = F.when(F.col("p_size") % 4 == 0, "x/job/1").otherwise(F.concat_ws(":", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.col("p_size").cast("string"), site))
    return read("part").select(F.col("p_name").alias("company"), F.when(F.col("p_size") % 3 == 0, "lever").otherwise("workday").alias("ats"), slug.alias("slug"))


@query(f"""
WITH r AS ({_REGISTRY}), w AS (SELECT company, string_split(slug, ':') AS p FROM r WHERE ats = 'workday' AND len(string_split(slug, ':')) = 3)
SELECT company, ats, slug FROM r WHERE ats <> 'workday'
UNION ALL SELECT arg_max(company, (length(company), company)), 'workday', p[1] || ':' || p[2] || ':Careers' FROM w GROUP BY 3
""")
def registry_cleanup(read):
    return registry.clean_workday(_registry(read))[0]


@query(f"SELECT count(*) FILTER (WHERE ats = 'workday') AS workday_before, count(DISTINCT split_part(slug, ':', 1) || ':' || split_part(slug, ':', 2)) FILTER (WHERE ats = 'workday' AND slug <> 'x/job/1') AS workday_after, count(*) FILTER (WHERE ats = 'workday' AND slug = 'x/job/1') AS dropped_unsalvageable, count(*) FILTER (WHERE ats <> 'workday') AS non_workday FROM ({_REGISTRY})")
def registry_cleanup_stats(read):
    return registry.clean_workday(_registry(read))[1]


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN slug = 'x/job/1' OR contains(slug, '/') OR contains(slug, '?') THEN 'malformed_slug' END AS reason FROM ({_REGISTRY})) WHERE reason IS NOT NULL GROUP BY 1")
def registry_rejects(read):
    return registry.validate(_registry(read))[1]


@query(f"SELECT ats, count(*) AS n, string_agg(DISTINCT company, ', ' ORDER BY company) AS names FROM ({_REGISTRY}) GROUP BY 1")
def registry_listing(read):
    return registry.listing(_registry(read))


@query(f"SELECT company, ats, slug FROM ({_REGISTRY}) WHERE lower(company) IN (SELECT lower(p_name) FROM part WHERE p_partkey IN (1, 2, 3))")
def priority_targets(read):
    names = [r.p_name.upper() for r in read("part").where(F.col("p_partkey").isin(1, 2, 3)).select("p_name").collect()]  # a list of three
    return registry.priority(_registry(read), names)


@query("""
SELECT p_partkey, CASE k WHEN 0 THEN b WHEN 1 THEN b || '-x' WHEN 2 THEN 'wd5' WHEN 3 THEN NULL END AS slug FROM (SELECT p_partkey, p_size % 4 AS k, replace(lower(p_brand), '#', '') AS b FROM part)
""")
def discovered_slugs(read):
    """The first pattern that matches decides, so a Workday host with a shard gives the shard."""
    b, k = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.col("p_size") % 4
    url = F.when(k == 0, F.concat(F.lit("https://Boards.Greenhouse.io/"), b, F.lit("/jobs/1"))).when(k == 1, F.concat(F.lit("https://jobs.lever.co/"), b, F.lit("-X?a=1"))).when(k == 2, F.concat(F.lit("https://"), b, F.lit(".wd5.myworkdayjobs.com/a"))).otherwise("https://jobs.lever.co/careers")
    ats = F.when(k == 0, "greenhouse").when(k == 2, "workday").otherwise("lever")
    return read("part").select("p_partkey", urls.discovered(url, ats).alias("slug"))


def _startup_pages(read) -> DataFrame:
    """The given pages with a card set into their text, or with the page's own payload at their end."""
    k, html = F.col("page_id"), F.col("html")
    card = F.concat(F.lit('<div data-company-name="'), F.initcap(F.substring("url", 9, 6)), F.lit(' &amp; Co"><p>x</p><a class="c" href="/jobs/'), k, F.lit('"> <b>Engineer</b> '), F.substring(F.md5("url"), 1, 5), F.lit(' </a><span class="job-location">'), F.when(k % 3 == 0, "Remote (US)").otherwise(F.concat(F.lit("Town "), k % 17)), F.lit("</span></div>"))
    job = F.to_json(F.struct(k.alias("id"), F.concat(F.lit("Analyst {"), F.substring(F.md5("url"), 1, 5), F.lit('} "x"')).alias("title"), F.struct(F.concat(F.lit("Firm "), k % 9).alias("name")).alias("company"), F.lit("Town").alias("location"), F.lit("2024-01-02").alias("created_at")))
    payload = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"jobs": ['), job, F.lit("]}}};</script>"))
    half = (F.length(html) / 2).cast("int")
    return read("pages").select("page_id", F.when(k % 2 == 0, F.concat(F.substring(html, F.lit(1), half), card, F.substring(html, half + 1, F.length(html)))).otherwise(F.concat(html, payload)).alias("html"))


@query(r"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN substr(html, 1, (length(html) // 2)::BIGINT) || '<div data-company-name="' || upper(substr(url, 9, 1)) || lower(substr(url, 10, 5)) || ' &amp; Co"><p>x</p><a class="c" href="/jobs/' || page_id || '"> <b>Engineer</b> ' || substr(md5(url), 1, 5) || ' </a><span class="job-location">' || CASE WHEN page_id % 3 = 0 THEN 'Remote (US)' ELSE 'Town ' || page_id % 17 END || '</span></div>' || substr(html, (length(html) // 2)::BIGINT + 1)
  ELSE html || '{"id":' || page_id || ',"title":"Analyst {' || substr(md5(url), 1, 5) || '} \"x\"","company":{"name":"Firm ' || page_id % 9 || '"},"location":"Town"}' END AS h FROM pages),
c AS (SELECT page_id, h, regexp_extract(h, '(?s)<a[^>]+href="/jobs/\d+"[^>]*>.*?</a>') AS a, regexp_extract(h, '\{"id":\d+.*\}$') AS j FROM p),
n AS (SELECT page_id, a, j, substr(h, greatest(1, instr(h, a) - 600), instr(h, a) - greatest(1, instr(h, a) - 600) + length(a) + 600) AS near FROM c)
SELECT 'yc_' || coalesce(nullif(regexp_extract(a, '/jobs/(\d+)', 1), ''), json_extract_string(j, '$.id')) AS job_id,
CASE WHEN a <> '' THEN trim(regexp_replace(regexp_replace(regexp_extract(a, '(?s)>(.*)</a>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) ELSE json_extract_string(j, '$.title') END AS title,
CASE WHEN a <> '' THEN replace(regexp_extract(near, 'data-company-name="([^"]+)"', 1), '&amp;', '&') ELSE json_extract_string(j, '$.company.name') END AS company,
CASE WHEN a <> '' THEN CASE WHEN regexp_matches(regexp_extract(near, 'class="job-location">([^<]+)<', 1), '(?i)\bremote\b') THEN 'Remote' ELSE regexp_extract(near, 'class="job-location">([^<]+)<', 1) END ELSE json_extract_string(j, '$.location') END AS location FROM n
""")
def startup_pages(read):
    """Postings of cards and of payloads that are set into the given pages."""
    return scripts.startup_postings(_startup_pages(read)).select("job_id", "title", "company", "location")


@query(r"""
WITH l AS (SELECT doc_id, trim(regexp_extract(text, '^[^\n]*'), ' ') AS t FROM documents),
k AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(t, '. ', ' | ') WHEN 1 THEN replace(t, ', ', ' – ') WHEN 2 THEN replace(t, ' the ', ' at ') WHEN 3 THEN replace(t, ' of ', ': ') ELSE t END AS t FROM l)
SELECT doc_id, CASE WHEN contains(t, '|') THEN trim(split_part(t, '|', 1), ' ') WHEN regexp_matches(t, '^.+?\s+[-—–]\s+.+$') THEN trim(regexp_extract(t, '^(.+?)\s+[-—–]\s+(.+)$', 1), ' ')
  WHEN regexp_matches(t, '(?i)^.+?\s+at\s+.+$') THEN trim(regexp_extract(t, '(?i)^(.+?)\s+at\s+(.+)$', 2), ' ') WHEN regexp_matches(t, '^[^:]{2,60}:\s+.+$') THEN trim(regexp_extract(t, '^([^:]{2,60}):', 1), ' ') ELSE trim(substr(t, 1, 80), ' ') END AS company,
CASE WHEN contains(t, '|') THEN trim(split_part(t, '|', 2), ' ') WHEN regexp_matches(t, '^.+?\s+[-—–]\s+.+$') THEN trim(regexp_extract(t, '^(.+?)\s+[-—–]\s+(.+)$', 2), ' ') WHEN regexp_matches(t, '(?i)^.+?\s+at\s+.+$') THEN trim(regexp_extract(t, '(?i)^(.+?)\s+at\s+(.+)$', 1), ' ') ELSE '' END AS title FROM k
""")
def hiring_lines(read):
    """Company and title of each document's first line, some of its words turned into the marks of the five forms."""
    first = F.trim(F.regexp_extract("text", r"^[^\n]*", 0))
    k = F.col("doc_id") % 5
    line = F.when(k == 0, F.replace(first, F.lit(". "), F.lit(" | "))).when(k == 1, F.replace(first, F.lit(", "), F.lit(" – "))).when(k == 2, F.replace(first, F.lit(" the "), F.lit(" at "))).when(k == 3, F.replace(first, F.lit(" of "), F.lit(": "))).otherwise(first)
    found = pages.hiring_line(line)
    return read("documents").select("doc_id", found["company"].alias("company"), found["title"].alias("title"))
