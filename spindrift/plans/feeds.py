"""Registered queries of candidates, validation records, metadata and run stores, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import feeds, rollups, similar, sketches, tables
from spindrift.plans.catalog import QUERIES, SQL, probe, query, table, ts
from spindrift.scratch import materialise
from spindrift.sources.footers import footer_bounds

#: Orders as postings: what the queries below read, in SQL.
_JOBS = """
SELECT o_orderkey::VARCHAR AS internal_hash, CASE o_orderstatus WHEN 'O' THEN 'unposted' ELSE 'posted' END AS status, o_totalprice > 50000 AS is_active, o_orderdate AS first_seen,
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'accepted' WHEN '2' THEN 'rejected' WHEN '3' THEN NULL ELSE 'accepted' END AS quality_state, floor(o_totalprice / 10000) AS quality_score, o_custkey AS company FROM orders
"""


def _jobs(read) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    state = F.when(first == "1", "accepted").when(first == "2", "rejected").when(first == "3", F.lit(None)).otherwise("accepted")
    return read("orders").select(F.col("o_orderkey").cast("string").alias("internal_hash"), F.when(F.col("o_orderstatus") == "O", "unposted").otherwise("posted").alias("status"), (F.col("o_totalprice") > 50000).alias("is_active"), F.col("o_orderdate").alias("first_seen"), state.alias("quality_state"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("quality_score"), F.col("o_custkey").alias("company"))


_SHOWN = ["internal_hash", "quality_score", "first_seen"]


@query(f"SELECT internal_hash, quality_score, first_seen FROM ({_JOBS}) WHERE status = 'unposted' AND is_active AND first_seen >= TIMESTAMP '1996-01-01' - INTERVAL 8760 HOUR AND quality_state = 'accepted' ORDER BY first_seen DESC, internal_hash LIMIT 300")
def unposted_candidates(read):
    return feeds.unposted_candidates(_jobs(read), ts("1996-01-01"), 8760, 300).select(*_SHOWN)


@query(f"SELECT internal_hash, quality_score, first_seen FROM ({_JOBS}) ORDER BY quality_score DESC, first_seen DESC, internal_hash LIMIT 75")
def push_batch(read):
    return feeds.push_batch(_jobs(read)).select(*_SHOWN)


@query(f"SELECT internal_hash, quality_score, first_seen, row_number() OVER (ORDER BY quality_score DESC, first_seen DESC, internal_hash) AS rank FROM ({_JOBS}) WHERE is_active AND quality_state = 'accepted' AND first_seen >= TIMESTAMP '2000-01-01' - INTERVAL 20000 HOUR")
def recent_accepted(read):
    return feeds.recent_accepted(_jobs(read), ts("2000-01-01"), 20_000).select(*_SHOWN, "rank")


@query(f"SELECT status, internal_hash FROM ({_JOBS}) WHERE internal_hash NOT IN (SELECT DISTINCT l_orderkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R')")
def unposted_rows(read):
    posted = read("lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").cast("string").alias("internal_hash"))
    return feeds.unposted(_jobs(read), posted).select("status", "internal_hash")


@query(f"SELECT company, max(first_seen) AS latest, count(*) AS n, md5(string_agg(internal_hash, ',' ORDER BY first_seen DESC, internal_hash)) AS rows_md5 FROM ({_JOBS}) GROUP BY 1")
def company_groups(read):
    return feeds.company_groups(_jobs(read), "company", "first_seen", "internal_hash").select("company", "latest", "n", F.md5(F.array_join("rows", ",")).alias("rows_md5"))


@query(f"SELECT company, count(*) AS raw, count(*) FILTER (WHERE quality_score >= 20) AS relevant FROM ({_JOBS}) GROUP BY 1")
def per_target(read):
    return feeds.per_target(_jobs(read), ["company"], F.col("quality_score") >= 20)


@query(f"SELECT quality_score AS value, count(*) AS n FROM ({_JOBS}) GROUP BY 1")
def score_distribution(read):
    return feeds.distribution(_jobs(read), F.col("quality_score"))


@query(f"SELECT company AS value, count(*) AS n FROM ({_JOBS}) WHERE first_seen >= TIMESTAMP '1999-01-01' GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def recent_by_source(read):
    return feeds.distribution(_jobs(read).where(F.col("first_seen") >= ts("1999-01-01")), F.col("company"), 15)


@query(f"SELECT internal_hash, round_even(epoch_us(TIMESTAMP '2001-01-01' - first_seen) / 60000000.0, 0)::BIGINT AS minutes FROM (SELECT internal_hash, first_seen + to_microseconds(29000000 + 1000000 * (internal_hash::BIGINT % 3)) AS first_seen FROM ({_JOBS}))".replace("epoch_us(TIMESTAMP '2001-01-01' - first_seen)", "(epoch_us(TIMESTAMP '2001-01-01') - epoch_us(first_seen))"))
def freshness_minutes(read):
    seconds = 29 + F.col("internal_hash").cast("long") % 3
    seen = F.col("first_seen").cast("timestamp") + F.make_dt_interval(secs=seconds)
    return _jobs(read).select("internal_hash", feeds.freshness_minutes(seen, ts("2001-01-01").cast("timestamp")).alias("minutes"))


@query("""
SELECT p_partkey, 'Title: ' || p_name || ' | Company: ' || p_brand || CASE WHEN p_size > 25 THEN ' | Location: ' || p_type ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ' | Description: ' || left(repeat(p_type || ' ', 150), 2000) ELSE '' END || ' | Category: ' || p_brand || ', ' || p_type AS text FROM part
""")
def embedding_text(read):
    place = F.when(F.col("p_size") > 25, F.col("p_type"))
    about = F.when(F.col("p_size") % 2 == 0, F.repeat(F.concat("p_type", F.lit(" ")), 150)).otherwise("")
    return read("part").select("p_partkey", feeds.embedding_text(F.col("p_name"), F.col("p_brand"), place, about, F.array("p_brand", "p_type")).alias("text"))


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice * 10.5 > 10000 AND p_retailprice * 15 > 10000 AND p_brand LIKE '%1%'")
def training_rows(read):
    jobs = read("part").select("p_partkey", (F.col("p_size") > 10).alias("is_active"), (F.col("p_retailprice") * 10.5).alias("salary_min"), (F.col("p_retailprice") * 15).alias("salary_max"), F.when(F.col("p_brand").contains("1"), "USD").otherwise("EUR").alias("salary_currency"))
    return feeds.training_rows(jobs).select("p_partkey")


@query("""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 2),
hits AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]), 4) AS similarity FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 30)
SELECT vec_id, similarity, source FROM hits JOIN documents ON vec_id = doc_id WHERE lang = 'en' ORDER BY similarity DESC, vec_id LIMIT 10
""")
def hits_with_rows(read):
    hits = similar.top_similar(read("embeddings"), "vec_id", "embedding", probe(read, 2), 30)
    active = read("documents").where(F.col("lang") == "en").select("doc_id", "source")
    return feeds.hits_with_rows(hits.select("vec_id", "similarity"), active, "vec_id", "doc_id", 10).select("vec_id", "similarity", "source")


_TARGETS = """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'workday' ELSE 'ashby' END AS ats_type, c_custkey::VARCHAR AS slug, 'P' || (c_custkey % 4) AS tier, (c_custkey % 11)::INTEGER AS consecutive_failures,
latest AS last_job_found_at, CASE WHEN c_acctbal > 0 THEN latest END AS next_due_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1) ON c_custkey = o_custkey
"""


def _targets(read) -> DataFrame:
    latest = read("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))
    k = F.col("c_custkey")
    ats = F.when(k % 3 == 0, "lever").when(k % 3 == 1, "workday").otherwise("ashby")
    rows = read("customer").join(latest, k == F.col("o_custkey"), "left")
    return rows.select(ats.alias("ats_type"), k.cast("string").alias("slug"), F.concat(F.lit("P"), k % 4).alias("tier"), (k % 11).cast("int").alias("consecutive_failures"), F.col("latest").alias("last_job_found_at"), F.when(F.col("c_acctbal") > 0, F.col("latest")).alias("next_due_at"), F.lit("healthy").alias("health_state"), F.lit(False).alias("is_dead"))


@query(f"SELECT slug FROM ({_TARGETS}) WHERE tier = 'P0' OR last_job_found_at IS NULL OR last_job_found_at >= TIMESTAMP '2001-01-01' - INTERVAL 90 DAY")
def ttl_backoff(read):
    return feeds.within_ttl(_targets(read), ts("2001-01-01"), 90).select("slug")


@query(f"SELECT ats_type, slug, next_due_at FROM ({_TARGETS}) ORDER BY next_due_at NULLS FIRST, ats_type, slug LIMIT 100")
def least_validated(read):
    return feeds.least_validated(_targets(read), 100, "next_due_at").select("ats_type", "slug", "next_due_at")


@query(f"""
SELECT slug, n AS consecutive_failures, CASE WHEN good THEN 'healthy' WHEN n >= least_n THEN 'quarantined' ELSE 'degraded' END AS health_state, NOT good AND n >= least_n AS is_dead,
CASE WHEN good THEN least(coalesce(next_due_at, TIMESTAMP '2000-01-01'), TIMESTAMP '2000-01-01')
ELSE TIMESTAMP '2000-01-01' + to_seconds(least(604800, base * greatest(2, least(8, n + 1)))) END AS next_due_at
FROM (SELECT *, CASE WHEN good THEN 0 ELSE consecutive_failures + 1 END::INTEGER AS n, CASE tier WHEN 'P0' THEN 900 WHEN 'P1' THEN 3600 WHEN 'P2' THEN 86400 ELSE 604800 END AS base
FROM (SELECT *, slug::BIGINT % 5 = 0 AS good, CASE WHEN slug::BIGINT % 5 = 1 THEN 3 ELSE 10 END AS least_n FROM ({_TARGETS})))
""")
def validation_record(read):
    targets = _targets(read)
    kind = F.col("slug").cast("long") % 5
    results = targets.select("ats_type", "slug", F.when(kind == 0, "ok").otherwise("failed").alias("status"), F.when(kind == 1, "bad_target").otherwise("timeout").alias("category"), F.lit(500).alias("http_status"))
    return feeds.record_validation(targets, results, ts("2000-01-01")).select("slug", "consecutive_failures", "health_state", "is_dead", "next_due_at")


@query(f"SELECT slug, CASE WHEN slug::BIGINT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'P0' ELSE tier END AS tier FROM ({_TARGETS})")
def forced_tiers(read):
    rich = read("orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").cast("string").alias("slug"))
    return feeds.force_tier(_targets(read), rich, keys=("slug",)).select("slug", "tier")


@query("SELECT event_id, '{\"a\":\"' || event_type || '\",\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS merged, '{}' AS removed FROM events")
def metadata_merge(read):
    new = F.create_map(F.lit("a"), F.col("event_type"))
    return read("events").select("event_id", feeds.merge_metadata(F.col("props"), new).alias("merged"), feeds.remove_metadata(F.col("props"), "k").alias("removed"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'lever' ELSE 'workday' END AS ats, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ':' || p_size || ':' || p_type ELSE p_brand || ':' || p_size || ':old' END AS slug, p_size % 3 < 2 AS used FROM part
""")
def cached_targets(read):
    k = F.col("p_size") % 3
    meta = F.when(k == 0, F.to_json(F.create_map(F.lit("resolved_ats"), F.lit(" Lever "), F.lit("resolved_slug"), F.col("p_brand")))).when(k == 1, F.to_json(F.create_map(F.lit("workday_site"), F.col("p_type")))).otherwise("not json")
    slug = F.concat_ws(":", "p_brand", F.col("p_size").cast("string"), F.lit("old"))
    t = feeds.cached_target(F.lit("Workday"), slug, meta, ["lever", "workday"])
    return read("part").select("p_partkey", t["ats"].alias("ats"), t["slug"].alias("slug"), t["used"].alias("used"))


@query("SELECT event_id AS run_id, event_type AS scraper, ts AS run_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_run(read):
    return feeds.latest_run(read("events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("scraper"), F.col("ts").alias("run_at")))


@query("SELECT event_type AS name, (count(*) + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS n, CASE WHEN event_type = 'view' THEN count(*) % 7 END::INTEGER AS shard FROM events GROUP BY 1")
def shard_cursor(read):
    return feeds.next_shard(read("events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")), "view", 7)


@query("SELECT c_mktsegment, count(*) AS n, sum(place)::BIGINT AS places FROM (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS place FROM customer) GROUP BY 1")
def shuffled_targets(read):
    """Every place is given once in each group, whatever the order."""
    out = feeds.shuffled(read("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 7)
    return out.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places"))


@query("""
SELECT o_custkey AS k, min(o_orderpriority) AS v, false AS is_new FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1
UNION ALL SELECT o_custkey, min(o_orderpriority), true FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01') GROUP BY 1
""")
def merged_store(read):
    orders = read("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderdate")
    early = orders.where(F.col("o_orderdate") < ts("1997-01-01")).groupBy("k").agg(F.min("v").alias("v"))
    return feeds.merge_store(early, orders.where(F.col("o_orderdate") >= ts("1997-01-01")).select("k", "v"), "k")


@query("SELECT event_id, event_type, NULL::VARCHAR AS note FROM events UNION ALL SELECT max(event_id) + 1, 'run', 'done' FROM events")
def appended_runs(read):
    runs = read("events").select("event_id", "event_type")
    run = runs.agg((F.max("event_id") + 1).alias("event_id")).select("event_id", F.lit("run").alias("event_type"), F.lit("done").alias("note"))
    return feeds.append_run(runs, run)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE event_type END AS state, user_id::VARCHAR AS kept, ts::DATE::VARCHAR AS updated_at FROM events")
def checkpoint_merge(read):
    old = F.create_map(F.lit("state"), F.col("event_type"), F.lit("kept"), F.col("user_id").cast("string"), F.lit("updated_at"), F.lit("before"))
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("state"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    m = feeds.merge_checkpoint(old, new, F.col("ts").cast("date").cast("string"))
    return read("events").select("event_id", m.alias("m")).select("event_id", F.col("m.state").alias("state"), F.col("m.kept").alias("kept"), F.col("m.updated_at").alias("updated_at"))


_SUMMARY = "SELECT event_type AS p, user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events"


@query(f"""
SELECT p AS platform, sum(k + 1)::BIGINT AS attempted, sum(k)::BIGINT AS succeeded, count(*) AS failed, sum(floor(value))::BIGINT AS jobs_fetched, round_even(sum(k) / sum(k + 1)::DOUBLE, 4) AS success_rate,
round_even(count(*) / sum(k + 1)::DOUBLE, 4) AS error_rate, round_even(sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) / sum(k + 1)::DOUBLE, 4) AS infra_rate FROM ({_SUMMARY}) GROUP BY 1
""")
def platform_health_runs(read):
    """Run summaries as JSON, a run an event, read back by the library."""
    return rollups.platform_health(_runs(read))


def _runs(read) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    entry = F.struct((k + 1).alias("attempted"), k.alias("succeeded"), F.lit(1).cast("long").alias("failed"), F.floor("value").alias("jobs_fetched"))
    failures = F.create_map(F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("parse"), F.lit(1).cast("long"))
    return read("events").select(F.to_json(F.struct(F.create_map("event_type", entry).alias("platforms"), F.create_map("event_type", failures).alias("failure_breakdown"))).alias("summary_json"))


@query(f"""
WITH h AS (SELECT p, sum(k + 1)::BIGINT AS a, sum(k)::BIGINT AS s, count(*) AS f, round_even(sum(k) / sum(k + 1)::DOUBLE, 4) AS r FROM ({_SUMMARY}) GROUP BY 1)
SELECT place, line FROM (VALUES (1, '## Health'), (2, '| Platform | Attempted | Succeeded | Failed | Success |'), (3, '|---|---|---|---|---|')) t(place, line)
UNION ALL SELECT (row_number() OVER (ORDER BY r, p) + 3)::INTEGER, printf('| %s | %d | %d | %d | %.2f%% |', p, a, s, f, r * 100) FROM h
""")
def health_report(read):
    return feeds.health_report(rollups.platform_health(_runs(read)), "Health")


@query("SELECT l_shipdate::DATE AS d, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') GROUP BY 1")
def stale_rows(read):
    """Rows of finished orders whose order is not among the latest."""
    lines = read("lineitem").select("l_orderkey", "l_shipdate").join(read("orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").withColumn("all", F.lit(1))
    latest = read("lineitem").where(F.col("l_returnflag") == "N").select("l_orderkey", F.lit(1).alias("all"))
    return tables.stale(lines, latest, "l_orderkey", ["all"]).groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT l_linenumber AS board, l_partkey % 500 AS k, max(l_shipdate) AS seen, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
latest AS (SELECT board, k FROM l WHERE seen >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 60 DAY AND board <> 3),
fetched AS (SELECT DISTINCT board FROM l WHERE board <> 5)
SELECT board::INTEGER AS board, k FROM l WHERE board IN (SELECT board FROM fetched) AND NOT EXISTS (SELECT 1 FROM latest t WHERE t.board = l.board AND t.k = l.k)
""")
def stale_by_board(read):
    """Ids that boards share: what each fetched board lost; one board came back empty, one was not fetched."""
    lines = read("lineitem").select(F.col("l_linenumber").alias("board"), (F.col("l_partkey") % 500).alias("k"), "l_shipdate")
    since = lines.agg(F.max("l_shipdate") - F.expr("INTERVAL 60 DAYS")).first()[0]
    current = lines.groupBy("board", "k").agg(F.max("l_shipdate").alias("seen"))
    latest = current.where((F.col("seen") >= F.lit(since)) & (F.col("board") != 3)).select("board", "k")
    fetched = current.where(F.col("board") != 5).select("board").distinct()
    return tables.stale(current, latest, "k", ["board"], fetched).select("board", "k")


@query("""
SELECT event_type, count(*) AS n, true AS users_near, true AS median_near FROM events WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY 1
""")
def sketched_stats(read):
    """Counts by kind of event from stored daily sketches, and whether distinct users and medians are as near as the sketches promise."""
    rows = read("events").select(F.col("ts").cast("date").alias("d"), "event_type", "user_id", "value")
    days = materialise(sketches.daily(rows, F.col("d"), ["event_type"], {"users": F.col("user_id")}, {"value": F.col("value")}), "daily-sketches")
    since = F.lit("2024-01-08").cast("date")
    asked = sketches.merged(days.where(F.col("day") >= since), ["event_type"], ["users"], {"median": ("value", 0.5)})
    exact = rows.where(F.col("d") >= since).join(F.broadcast(asked), "event_type").groupBy("event_type", "n", "users", "median")
    exact = exact.agg(F.count_distinct("user_id").alias("real"), F.avg((F.col("value") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("median")).cast("double")).alias("upto"))
    near = (F.col("below") <= 0.5 + 0.02) & (F.col("upto") >= 0.5 - 0.02)
    return exact.select("event_type", "n", (F.abs(F.col("users") - F.col("real")) <= 0.03 * F.col("real") + 1).alias("users_near"), near.alias("median_near"))


_COUNTED = {"documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"], "labels": ["doc_id", "quality"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_quantity"], "events": ["event_id", "value"]}


def table_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bounds of two columns of each table, from footers alone."""
    out = None
    for name, columns in _COUNTED.items():
        one = footer_bounds(spark, f"{sf_dir}/{name}.parquet", columns)
        numbers = [F.col(f"{end}_{c}").cast("double").alias(f"{end}_{i}") for i, c in enumerate(columns) for end in ("least", "most")]
        one = one.select(F.lit(name).alias("name"), "n", *numbers)
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["table_bounds"] = table_bounds
SQL["table_bounds"] = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, {', '.join(f'{f}({c})::DOUBLE AS {n}_{i}' for i, c in enumerate(cs) for n, f in (('least', 'min'), ('most', 'max')))} FROM {t}" for t, cs in _COUNTED.items())
