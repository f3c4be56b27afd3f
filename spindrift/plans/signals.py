"""Registered queries of classifiers and extractors over texts that Spark derives from the tables, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import classify, dates, extract
from spindrift.functions import vocabulary as V
from spindrift.plans.catalog import query



@query("""
SELECT o_orderkey, CASE k % 4 WHEN 3 THEN NULL ELSE low END AS salary_min, CASE k % 4 WHEN 3 THEN NULL ELSE high END AS salary_max FROM (
SELECT o_orderkey, o_orderkey AS k, CAST((20 + o_orderkey % 200) * 1000 AS DOUBLE) AS low, CAST((50 + o_orderkey % 200) * 1000 AS DOUBLE) AS high FROM orders)
""")
def salary_extract(read):
    """Pay written in three ways; the fourth is revenue."""
    low, high = (F.format_string("%d", n + F.col("o_orderkey") % 200) for n in (20, 50))
    said = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("<p>Salary range: $"), low, F.lit("k - $"), high, F.lit("k</p>")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("We pay $"), low, F.lit(",000 to $"), high, F.lit(",000.")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Pay band: $"), low, F.lit(",000 &ndash; $"), high, F.lit(",000 per year")))
        .otherwise(F.concat(F.lit("Made $"), low, F.lit("m in revenue, $"), low, F.lit("k - $"), high, F.lit("k")))
    )
    pay = read("orders").select("o_orderkey", extract.salary(said).alias("s"))
    return pay.select("o_orderkey", F.col("s.salary_min").alias("salary_min"), F.col("s.salary_max").alias("salary_max"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE (1 + o_orderkey % 12)::INTEGER END AS years FROM orders")
def experience_extract(read):
    n, more = F.format_string("%d", 1 + F.col("o_orderkey") % 12), F.format_string("%d", 3 + F.col("o_orderkey") % 12)
    said = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(n, F.lit("-"), more, F.lit(" years of hands on experience")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("At least "), n, F.lit(" years of relevant experience")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(n, F.lit("+ years building things")))
        .otherwise(F.concat(F.lit("founded "), n, F.lit(" decades ago")))
    )
    return read("orders").select("o_orderkey", extract.experience_years(said).alias("years"))


_LEVELS, _ROLES = ("Senior", "Junior", "Lead", ""), ("Software Engineer", "Data Analyst", "Machine Learning Engineer", "Plumber", "Product Manager")


@query("""
SELECT p_partkey, trim(CASE WHEN p_partkey % 4 = 1 AND p_partkey % 5 <> 3 AND p_partkey % 5 <> 4 THEN 'New Grad,' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN 'SWE' WHEN 1 THEN 'Data Analyst' WHEN 2 THEN 'AI/ML' WHEN 3 THEN '' ELSE 'Product' END, ',') AS roles FROM part
""")
def role_categories(read):
    """Titles of a level and a role; managers are never early careers."""
    k = F.col("p_partkey")
    title = F.concat_ws(" ", F.get(F.lit(list(_LEVELS)), (k % 4).cast("int")), F.get(F.lit(list(_ROLES)), (k % 5).cast("int")))
    return read("part").select("p_partkey", F.array_join(classify.roles(title), ",").alias("roles"))


@query(f"""
SELECT c_custkey, CASE WHEN regexp_matches(n_name, '{V.NON_US}') THEN false ELSE regexp_matches(n_name, '{V.US_NAME}') END AS strict, NOT regexp_matches(n_name, '{V.NON_US}') AS permissive FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def us_predicates(read):
    rows = read("customer").select("c_custkey", "c_nationkey").join(read("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", classify.is_us_strict(F.col("n_name")).alias("strict"), classify.is_us_permissive(F.col("n_name")).alias("permissive"))


@query("""
SELECT o_orderkey, CASE WHEN s AND NOT g AND NOT b THEN 'accepted' WHEN g OR b THEN 'rejected' ELSE 'needs_review' END AS state,
greatest(0.0, round(1.0 - CASE WHEN s THEN 0 ELSE 0.45 END - CASE WHEN b THEN 0.35 ELSE 0 END - CASE WHEN g THEN 0.25 ELSE 0 END, 2))::DOUBLE AS confidence,
CASE WHEN g THEN 'missing_title' WHEN b THEN 'non_job_url' END AS gate
FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS s, o_orderkey % 3 = 0 AS g, o_orderkey % 5 = 0 AS b FROM orders)
""")
def quality_class(read):
    """Postings whose source, title and address are sound or not by their key."""
    source, title = F.when(F.col("o_orderkey") % 2 == 0, "lever").otherwise("rss"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("Data Engineer")
    url = F.concat(F.lit("https://jobs.lever.co/acme/"), F.when(F.col("o_orderkey") % 5 == 0, "search?q=x").otherwise(F.col("o_orderkey").cast("string")))
    q = classify.quality(title, F.lit("Acme"), url, source)
    return read("orders").select("o_orderkey", q["state"].alias("state"), q["confidence"].alias("confidence"), classify.first_failure(title, F.lit("Acme"), F.lit("Remote"), url, source).alias("gate"))


@query("""
SELECT event_id, greatest(0.0, least(100.0, CASE WHEN user_id % 5 = 0 THEN 25 ELSE 0 END + CASE WHEN value > 50 THEN 15 ELSE 0 END + 10 + 20 * CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.7 ELSE 0 END + 5 - CASE WHEN event_type = 'error' THEN 30 ELSE 0 END))::DOUBLE AS score FROM events
""")
def quality_score(read):
    kind = F.col("event_type")
    title = F.when(kind == "view", "ML Engineer").when(kind == "click", "Data Analyst").when(kind == "error", "Director of Sales").otherwise("Clerk")
    score = classify.quality_score(title, F.lit(""), F.when(F.col("value") > 50, F.col("value")), classify.roles(title), F.col("user_id") % 5 == 0)
    return read("events").select("event_id", score.alias("score"))


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AS recent FROM events")
def window_predicate(read):
    """Whether a time written as text lies within 48 hours before a moment, in three spellings."""
    at = F.col("ts").cast("timestamp")
    micros = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = F.when(F.col("event_id") % 2 == 0, micros).otherwise(F.concat(F.unix_seconds(at).cast("string"), F.lit("."), F.date_format(at, "SSSSSS")))
    return read("events").select("event_id", dates.within(text, F.lit("2024-01-20 00:00:00").cast("timestamp"), 48).alias("recent"))


@query("""
SELECT event_id, CASE WHEN c IN (404) THEN 'bad_target' WHEN c = 429 THEN 'rate_limited' WHEN c = 403 THEN 'anti_bot' WHEN c >= 500 THEN 'connection' WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'view' THEN 'parse' ELSE 'unknown' END AS category
FROM (SELECT event_id, event_type, CASE event_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 403 WHEN 3 THEN 200 WHEN 4 THEN NULL ELSE 200 END AS c FROM events)
""")
def failure_class(read):
    code = F.get(F.array(*map(F.lit, (404, 429, 403, 200, None, 200))), (F.col("event_id") % 6).cast("int"))
    said = F.when(F.col("event_type") == "error", "read timeout").when(F.col("event_type") == "view", "json decode failed").otherwise("")
    return read("events").select("event_id", classify.failure(code, said).alias("category"))
