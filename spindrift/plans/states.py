"""Next states of targets, trackers, memories and postings over the given tables, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import extract, text
from spindrift.operators import schedule, search, tables
from spindrift.operators.versions import VersionedTable
from spindrift.plans.catalog import query, ts
from spindrift.scratch import scratch_path
from spindrift.streaming import events

NOW = "2001-07-15"

#: Customers as targets, their last order as what they are due by.
_TARGETS = f"""
SELECT c_mktsegment AS ats_type, c_custkey::VARCHAR AS slug, 'P' || (c_custkey % 4) AS tier, latest AS next_due_at, floor(c_acctbal / 100)::DOUBLE AS scrape_score, c_custkey % 13 = 0 AS is_dead,
CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '{NOW}' + to_hours((c_custkey % 5 - 2)::INTEGER) END AS lease_until, CASE WHEN c_custkey % 7 = 0 THEN 'other' END AS lease_owner,
(c_custkey % 12)::INTEGER AS consecutive_failures, (c_custkey % 30)::INTEGER AS total_scrapes, 0::BIGINT AS total_jobs_found
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1) ON c_custkey = o_custkey
"""


def _targets(read) -> DataFrame:
    latest = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("next_due_at"))
    k = F.col("c_custkey")
    lease = ts(NOW) + F.make_dt_interval(hours=(k % 5 - 2).cast("int"))
    return read("customer").join(latest, "c_custkey", "left").select(
        F.col("c_mktsegment").alias("ats_type"), k.cast("string").alias("slug"), F.concat(F.lit("P"), k % 4).alias("tier"), "next_due_at", F.floor(F.col("c_acctbal") / 100).cast("double").alias("scrape_score"), F.lit(0.0).alias("priority_score"), F.lit(0.0).alias("fresh_job_rate"), (k % 13 == 0).alias("is_dead"),
        F.when(k % 7 == 0, lease).alias("lease_until"), F.when(k % 7 == 0, F.lit("other")).alias("lease_owner"), (k % 12).cast("int").alias("consecutive_failures"), F.lit("healthy").alias("health_state"), (k % 30).cast("int").alias("total_scrapes"), F.lit(0).cast("long").alias("total_jobs_found"), F.lit(0).cast("long").alias("total_relevant_jobs_found"),
        F.lit(None).cast("timestamp_ntz").alias("last_success_at"), F.lit(None).cast("timestamp_ntz").alias("last_job_found_at"))


@query(f"""
WITH t AS ({_TARGETS}), due AS (SELECT slug, row_number() OVER (ORDER BY CASE WHEN next_due_at <= TIMESTAMP '{NOW}' - INTERVAL 14 DAY THEN 0 ELSE 1 END, tier, scrape_score DESC, next_due_at NULLS FIRST, slug) AS r
FROM t WHERE NOT is_dead AND (lease_until IS NULL OR lease_until < TIMESTAMP '{NOW}') AND (next_due_at IS NULL OR next_due_at <= TIMESTAMP '{NOW}'))
SELECT t.slug, CASE WHEN r <= 120 THEN 'me' ELSE lease_owner END AS lease_owner, CASE WHEN r <= 120 THEN TIMESTAMP '{NOW}' + INTERVAL 30 MINUTE ELSE lease_until END AS lease_until, coalesce(r <= 120, false) AS claimed FROM t LEFT JOIN due USING (slug)
""")
def claimed_targets(read):
    """Leases after one worker claims the first 120 targets that are due, alive and free."""
    return schedule.claim(_targets(read), "me", ts(NOW), 30, 120).select("slug", "lease_owner", "lease_until", "claimed")


@query(f"""
WITH t AS ({_TARGETS}), o AS (SELECT o_custkey::VARCHAR AS slug, count(*) AS jobs, count(*) FILTER (WHERE o_totalprice > 250000) AS relevant, min(o_totalprice) < 20000 AS failed FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1),
a AS (SELECT t.*, o.slug IS NOT NULL AS came, coalesce(failed, false) AS failed, coalesce(jobs, 0) AS jobs, coalesce(relevant, 0) AS relevant FROM t LEFT JOIN o USING (slug)),
b AS (SELECT *, CASE WHEN came AND failed THEN consecutive_failures + 1 WHEN came THEN 0 ELSE consecutive_failures END AS n, CASE WHEN came AND relevant > 0 AND tier IN ('P2', 'P3') THEN 'P1' WHEN came AND NOT failed AND jobs = 0 AND tier = 'P2' AND total_scrapes >= 10 THEN 'P3' ELSE tier END AS t2 FROM a),
c AS (SELECT *, CASE t2 WHEN 'P0' THEN 900 WHEN 'P1' THEN 3600 WHEN 'P2' THEN 86400 ELSE 604800 END AS base FROM b)
SELECT slug, t2 AS tier, n::INTEGER AS consecutive_failures, CASE WHEN NOT came THEN 'healthy' WHEN n >= 10 THEN 'dead' WHEN n >= 2 THEN 'degraded' ELSE 'healthy' END AS health_state, CASE WHEN came THEN n >= 10 ELSE is_dead END AS is_dead, (total_scrapes + came::INTEGER)::INTEGER AS total_scrapes, jobs::BIGINT AS total_jobs_found,
CASE WHEN came THEN TIMESTAMP '{NOW}' + to_seconds(CASE WHEN failed THEN least(604800, base * greatest(2, least(8, n + 1))) WHEN relevant > 0 THEN least(base, 3600) WHEN jobs > 0 THEN least(base, 14400) WHEN n >= 5 THEN least(604800, base * 3) ELSE base END) ELSE next_due_at END AS next_due_at,
CASE WHEN came THEN NULL ELSE lease_owner END AS lease_owner FROM c
""")
def visited_targets(read):
    """Targets after a round of visits: counters, tiers, health, next due times and leases."""
    o = read("orders").where(F.col("o_orderdate") >= ts("2000-01-01"))
    came = o.groupBy(F.col("o_custkey").cast("string").alias("slug")).agg(F.count(F.lit(1)).alias("job_count"), F.count_if(F.col("o_totalprice") > 250000).alias("relevant_count"), (F.min("o_totalprice") < 20000).alias("failed"))
    targets = _targets(read)
    outcomes = came.join(targets.select("ats_type", "slug"), "slug")
    return tables.visit(targets, outcomes, ts(NOW)).select("slug", "tier", "consecutive_failures", "health_state", "is_dead", "total_scrapes", "total_jobs_found", "next_due_at", "lease_owner")


_STAGES = "CASE o_orderstatus WHEN 'O' THEN 'saved' WHEN 'F' THEN 'applied' ELSE 'interview' END"


@query(f"""
WITH r AS (SELECT o_custkey AS user_id, o_orderkey % 40 AS job_hash, {_STAGES} AS stage, o_orderdate AS at_, o_orderkey, o_orderdate >= TIMESTAMP '1999-01-01' AS fresh FROM orders),
s AS (SELECT user_id, job_hash, fresh, arg_max(stage, o_orderkey) AS stage, min(at_) FILTER (WHERE stage = 'applied') AS applied_at FROM r GROUP BY 1, 2, 3)
SELECT user_id, job_hash, CASE WHEN max(fresh::INTEGER) = 1 THEN max(stage) FILTER (WHERE fresh) ELSE max(stage) END AS stage, coalesce(min(applied_at) FILTER (WHERE NOT fresh), CASE WHEN (CASE WHEN max(fresh::INTEGER) = 1 THEN max(stage) FILTER (WHERE fresh) ELSE max(stage) END) = 'applied' THEN TIMESTAMP '{NOW}' END) AS applied_at
FROM s GROUP BY 1, 2
""")
def tracked_applications(read):
    """Tracker rows after updates: the newer stage counts, the day of applying is set once."""
    stage = F.when(F.col("o_orderstatus") == "O", "saved").when(F.col("o_orderstatus") == "F", "applied").otherwise("interview")
    rows = read("orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 40).alias("job_hash"), stage.alias("stage"), "o_orderdate", "o_orderkey")

    def side(some: DataFrame) -> DataFrame:
        return some.groupBy("user_id", "job_hash").agg(F.max_by("stage", "o_orderkey").alias("stage"), F.min(F.when(F.col("stage") == "applied", F.col("o_orderdate"))).alias("applied_at"))

    cut = F.col("o_orderdate") >= ts("1999-01-01")
    return tables.track(side(rows.where(~cut)), side(rows.where(cut)).drop("applied_at"), ts(NOW))


@query("""
WITH r AS (SELECT o_custkey % 700 AS h, o_orderdate AS at_, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS source, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS posted, o_orderdate >= TIMESTAMP '2000-01-01' AS fresh FROM orders),
s AS (SELECT h, fresh, min(at_) AS first_seen, max(at_) AS last_seen, max(posted) AS posted_at, max(source) AS source FROM r WHERE h % 5 <> 0 OR NOT fresh GROUP BY 1, 2)
SELECT h AS internal_hash, min(first_seen) AS first_seen, max(last_seen) AS last_seen, coalesce(max(posted_at) FILTER (WHERE fresh), max(posted_at)) AS posted_at, coalesce(max(nullif(source, '')) FILTER (WHERE fresh), max(nullif(source, ''))) AS source FROM s GROUP BY 1
""")
def fingerprint_memory(read):
    """The long memory of postings after a batch: first and last seen, what newer rows know."""
    source = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    rows = read("orders").select((F.col("o_custkey") % 700).alias("internal_hash"), "o_orderdate", source.alias("source"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("posted"))

    def side(some: DataFrame) -> DataFrame:
        return some.groupBy("internal_hash").agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), F.max("posted").alias("posted_at"), F.max("source").alias("source"))

    cut = F.col("o_orderdate") >= ts("2000-01-01")
    return tables.merge_fingerprints(side(rows.where(~cut)), side(rows.where(cut & (F.col("internal_hash") % 5 != 0))))


@query("""
WITH j AS (SELECT doc_id, TIMESTAMP '2024-03-01' - to_hours((doc_id % 1200)::INTEGER) AS seen, CASE doc_id % 3 WHEN 0 THEN 'unposted' WHEN 1 THEN 'posted' ELSE 'archived' END AS status, CASE doc_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN NULL ELSE 'accepted' END AS state, doc_id % 5 <> 0 AS active, trim(text, ' ') AS d FROM documents),
a AS (SELECT *, CASE WHEN status = 'unposted' AND seen < TIMESTAMP '2024-03-01' - INTERVAL 72 HOUR THEN 'archived' ELSE status END AS s, seen < TIMESTAMP '2024-03-01' - INTERVAL 3 DAY AS o3, seen < TIMESTAMP '2024-03-01' - INTERVAL 7 DAY AS o7, seen < TIMESTAMP '2024-03-01' - INTERVAL 30 DAY AS o30 FROM j)
SELECT doc_id, s AS status, sha256(CASE WHEN o3 THEN '' WHEN length(d) > 4000 THEN rtrim(substr(d, 1, 4000), ' ') ELSE coalesce(nullif(d, ''), 'none') END) AS description FROM a
WHERE NOT (coalesce(state, 'needs_review') = 'rejected' AND o3) AND NOT (coalesce(state, 'needs_review') = 'needs_review' AND o3) AND NOT (s = 'archived' AND o7) AND NOT (NOT active AND coalesce(state, 'needs_review') = 'accepted' AND o30) AND NOT (NOT active AND coalesce(state, 'needs_review') <> 'accepted' AND o7)
""")
def retained_jobs(read):
    """Documents as postings after retention: whole rows kept, descriptions capped or cleared, old ones archived."""
    k = F.col("doc_id")
    seen = ts("2024-03-01") - F.make_dt_interval(hours=(k % 1200).cast("int"))
    jobs = read("documents").select("doc_id", seen.alias("last_seen_at"), seen.alias("first_seen"), F.when(k % 3 == 0, "unposted").when(k % 3 == 1, "posted").otherwise("archived").alias("status"), F.when(k % 4 == 0, "rejected").when(k % 4 == 1, F.lit(None)).otherwise("accepted").alias("quality_state"), (k % 5 != 0).alias("is_active"), F.col("text").alias("description"))
    kept, _ = tables.retain(jobs, ts("2024-03-01"))
    return kept.select("doc_id", "status", F.sha2(F.coalesce("description", F.lit("none")), 256).alias("description"))


@query(r"""
SELECT page_id, (len(regexp_extract_all(t, 'https?://\S+')) * 23 + 2 * length(p) - length(regexp_replace(p, '[^\x{0}-\x{10FF}\x{2000}-\x{200D}\x{2010}-\x{201F}\x{2032}-\x{2037}]', '', 'g')))::INTEGER AS n
FROM (SELECT page_id, t, regexp_replace(t, 'https?://\S+', '', 'g') AS p FROM (SELECT page_id, url || ' ' || regexp_extract(html, '(?is)<title>(.*?)</title>', 1) || ' 日本 – ' || url AS t FROM pages))
""")
def weighted_lengths(read):
    """What a short message of a page's title and address would count."""
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return read("pages").select("page_id", text.weighted_length(F.concat("url", F.lit(" "), title, F.lit(" 日本 – "), "url")).cast("int").alias("n"))


@query(r"""
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '$' || format('{:d}', p_size) || 'k - ' || format('{:d}', p_size + 20) || 'K' WHEN 1 THEN '€' || format('{:,d}', p_size * 1000) || ' – €' || format('{:,d}', p_size * 1500) WHEN 2 THEN '£' || format('{:d}', p_size * 1000) ELSE p_name END AS s FROM part),
c AS (SELECT p_partkey, s, replace(trim(regexp_replace(s, '[$£€¥]', '', 'g'), ' '), ',', '') AS x FROM t),
n AS (SELECT p_partkey, s, CASE WHEN regexp_matches(x, '\d\s*[kK]?\s*[-–—]\s*\d') THEN regexp_extract_all(x, '\d+(?:\.\d+)?')[1] ELSE nullif(regexp_extract(x, '\d+(?:\.\d+)?'), '') END AS a, CASE WHEN regexp_matches(x, '\d\s*[kK]?\s*[-–—]\s*\d') THEN regexp_extract_all(x, '\d+(?:\.\d+)?')[2] ELSE nullif(regexp_extract(x, '\d+(?:\.\d+)?'), '') END AS b FROM c)
SELECT p_partkey, CASE WHEN contains(lower(s), 'k') AND a::DOUBLE < 1000 THEN a::DOUBLE * 1000 ELSE a::DOUBLE END AS low, CASE WHEN contains(lower(s), 'k') AND b::DOUBLE < 1000 THEN b::DOUBLE * 1000 ELSE b::DOUBLE END AS high,
CASE WHEN contains(s, '€') THEN 'EUR' WHEN contains(s, '£') THEN 'GBP' ELSE 'USD' END AS currency FROM n
""")
def salary_ranges(read):
    """Short salary texts in three spellings, and names that hold none, read back."""
    k, size = F.col("p_partkey"), F.col("p_size")
    said = F.when(k % 4 == 0, F.concat(F.lit("$"), size, F.lit("k - "), size + 20, F.lit("K"))).when(k % 4 == 1, F.concat(F.lit("€"), F.format_number(size * 1000, 0), F.lit(" – €"), F.format_number(size * 1500, 0))).when(k % 4 == 2, F.concat(F.lit("£"), size * 1000)).otherwise(F.col("p_name"))
    s = extract.salary_range(said)
    return read("part").select("p_partkey", s["salary_min"].alias("low"), s["salary_max"].alias("high"), s["currency"].alias("currency"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(coalesce(source, '')), 'licens') OR contains(lower(coalesce(text, '')), 'licens') OR contains(lower(coalesce(lang, '')), 'licens')")
def any_field_contains(read):
    """Documents any of whose fields holds a substring, in any case."""
    return search.faceted(read("documents"), any_contains=(["source", "text", "lang"], "LICENS")).select("doc_id", "source")


@query(f"""
WITH s AS (SELECT o_custkey AS slug, max(o_orderdate) AS last, (count(*) % 7)::INTEGER AS empty FROM orders GROUP BY 1)
SELECT c_custkey AS slug, c_mktsegment AS ats FROM customer LEFT JOIN s ON slug = c_custkey
WHERE last IS NULL OR epoch(TIMESTAMP '{NOW}') - epoch(last) >= CASE c_mktsegment WHEN 'BUILDING' THEN 7776000 WHEN 'MACHINERY' THEN 2592000 ELSE 31536000 END * CASE WHEN empty >= 5 THEN 3 ELSE 1 END
""")
def targets_to_visit(read):
    """Targets whose last visit is longer ago than their platform's interval, three times that after five empty visits."""
    state = read("orders").groupBy(F.col("o_custkey").alias("slug")).agg(F.max("o_orderdate").cast("timestamp").alias("last_scraped"), (F.count(F.lit(1)) % 7).cast("int").alias("consecutive_empty"))
    targets = read("customer").select(F.col("c_custkey").alias("slug"), F.col("c_mktsegment").alias("ats"))
    state = state.join(targets, "slug")
    return events.needs_visit(targets, state, F.lit(NOW).cast("timestamp"), {"BUILDING": 7_776_000, "MACHINERY": 2_592_000}, 31_536_000)


@query(f"""
WITH t AS ({_TARGETS}), due AS (SELECT slug, row_number() OVER (ORDER BY CASE WHEN next_due_at <= TIMESTAMP '{NOW}' - INTERVAL 14 DAY THEN 0 ELSE 1 END, tier, scrape_score DESC, next_due_at NULLS FIRST, slug) AS r
FROM t WHERE NOT is_dead AND (lease_until IS NULL OR lease_until < TIMESTAMP '{NOW}') AND (next_due_at IS NULL OR next_due_at <= TIMESTAMP '{NOW}'))
SELECT slug, CASE WHEN r <= 150 THEN 'first' ELSE 'second' END AS lease_owner FROM due WHERE r <= 300
""")
def exclusive_claims(read):
    """Two workers claim 150 targets each from a versioned table: what either holds in the end."""
    targets = _targets(read)
    table = VersionedTable(targets.sparkSession, scratch_path(targets.sparkSession, "targets"))
    table.commit(targets, -1)
    for owner in ("first", "second"):
        table.change(lambda t, owner=owner: schedule.claim(t.drop("claimed"), owner, ts(NOW), 30, 150))
    return table.read().where(F.col("lease_owner").isin("first", "second")).select("slug", "lease_owner")
