import datetime as dt
import json

from pyspark.sql import functions as F

from spindrift.operators import rollups, schedule, search, similar, tables
from spindrift.operators.components import components
from spindrift.streaming import events

def now():
    return F.lit("2026-03-05 12:00:00").cast("timestamp")


AT = dt.datetime(2026, 3, 5, 12)


def days(n):
    return AT - dt.timedelta(days=n)


def test_upsert_fills_replaces_and_marks_new(spark):
    schema = "k string, score int, note string, seen timestamp"
    old = spark.createDataFrame([("a", 1, "", days(2)), ("b", 2, "kept", days(2))], schema)
    new = spark.createDataFrame([("a", 5, "filled", AT), ("a", 9, "second", AT), ("c", 3, "new", AT)], schema)
    out = tables.upsert(old, new, ["k"], replace=["score"], fill=["note"], order=[F.col("score")], touched={"seen": now()}, inserted={"seen": now()})
    got = {r.k: (r.score, r.note, r.seen, r.is_new) for r in out.collect()}
    assert got == {"a": (5, "filled", AT, False), "b": (2, "kept", days(2), False), "c": (3, "new", AT, True)}


def test_retention_keeps_fingerprints_apart(spark):
    schema = "internal_hash string, status string, quality_state string, is_active boolean, first_seen timestamp, last_seen_at timestamp, description string"
    rows = [("rejected", "unposted", "rejected", True, days(5), days(5), "x"), ("good", "posted", "accepted", True, days(5), days(5), "x"), ("old", "posted", "accepted", False, days(45), days(45), "x"), ("fresh", "unposted", None, True, days(0), days(0), "y" * 50)]
    kept, counts = tables.retain(spark.createDataFrame(rows, schema), now(), longest=24)
    assert {r.internal_hash: len(r.description) for r in kept.collect()} == {"good": 0, "fresh": 24}
    assert {r.reason: r.n for r in counts.collect()} == {"rejected": 1, "inactive_accepted": 1}
    mark = "internal_hash string, first_seen timestamp, last_seen timestamp, posted_at timestamp, source string"
    got = tables.merge_fingerprints(spark.createDataFrame([("a", days(9), days(9), days(9), "lever")], mark), spark.createDataFrame([("a", days(1), days(1), None, "")], mark)).first()
    assert (got.first_seen, got.last_seen, got.posted_at, got.source) == (days(9), days(1), days(9), "lever")


def test_stale_only_in_fetched_scopes(spark):
    schema = "h string, source string, company string"
    current = spark.createDataFrame([("1", "a", "x"), ("2", "a", "x"), ("3", "b", "y")], schema)
    latest = spark.createDataFrame([("1", "a", "x")], schema)
    assert [r.h for r in tables.stale(current, latest, "h", ["source", "company"]).collect()] == ["2"]


def target(slug, tier, due, score=0.0, **more):
    base = {"ats_type": "lever", "slug": slug, "tier": tier, "next_due_at": due, "scrape_score": score, "priority_score": 0.0, "fresh_job_rate": 0.0, "is_dead": False, "lease_until": None, "lease_owner": None, "consecutive_failures": 0, "health_state": "healthy", "total_scrapes": 0, "total_jobs_found": 0, "total_relevant_jobs_found": 0, "last_success_at": None, "last_job_found_at": None}
    return base | more


TARGETS = "ats_type string, slug string, tier string, next_due_at timestamp, scrape_score double, priority_score double, fresh_job_rate double, is_dead boolean, lease_until timestamp, lease_owner string, consecutive_failures int, health_state string, total_scrapes int, total_jobs_found int, total_relevant_jobs_found int, last_success_at timestamp, last_job_found_at timestamp"


def frame(spark, *rows):
    names = [c.split()[0] for c in TARGETS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], TARGETS)


def test_claims_are_exclusive_and_aged_ones_come_first(spark):
    t = frame(spark, target("a", "P2", days(0.1)), target("b", "P0", days(0.1)), target("c", "P0", days(-1)), target("d", "P3", days(60)))
    once = schedule.claim(t, "me", now(), 30, 2)
    assert {r.slug for r in once.where("claimed").collect()} == {"d", "b"}
    twice = schedule.claim(once.drop("claimed"), "you", now(), 30, 10)
    assert {r.slug for r in twice.where("claimed").collect()} == {"a"}
    assert schedule.release(once, "me").where("lease_owner is not null").count() == 0


def test_visits_update_counters_tiers_and_health(spark):
    t = frame(spark, target("a", "P2", None), target("b", "P2", None, total_scrapes=10), target("c", "P1", None, consecutive_failures=9), target("d", "P3", None))
    o = spark.createDataFrame([("lever", "a", 5, 2, False), ("lever", "b", 0, 0, False), ("lever", "c", 0, 0, True)], "ats_type string, slug string, job_count int, relevant_count int, failed boolean")
    got = {r.slug: r for r in tables.visit(t, o, now()).collect()}
    assert (got["a"].tier, got["a"].total_jobs_found, got["b"].tier, got["c"].is_dead, got["c"].health_state, got["d"].total_scrapes) == ("P1", 5, "P3", True, "dead", 0)


def test_shards_split_contiguously(spark):
    for n, k in ((10, 4), (7, 3), (3, 4)):
        rows = schedule.shard(spark.range(n).withColumnRenamed("id", "k"), "k", k).orderBy("k").collect()
        want = spark.range(n).selectExpr("id", f"ntile({k}) over (order by id) - 1 as s").orderBy("id").collect()
        assert [r.shard for r in rows] == [r.s for r in want]


def test_platform_health(spark):
    def run(ok, bad, kinds):
        return (json.dumps({"platforms": {"p": {"attempted": 100, "succeeded": ok, "failed": bad, "jobs_fetched": 7}}, "failure_breakdown": {"p": kinds}}),)

    rows = [run(80, 20, {"rate_limited": 12, "bad_target": 8}), run(90, 10, {"timeout": 4, "bad_target": 6}), ("junk",), (json.dumps({"platforms": {"q": {"attempted": 0}}}),)]
    got = {r.platform: r for r in rollups.platform_health(spark.createDataFrame(rows, "summary_json string")).collect()}
    assert (got["p"].success_rate, got["p"].error_rate, got["p"].infra_rate, got["q"].success_rate) == (0.85, 0.15, 0.08, None)


def test_search_syntax(spark):
    assert search.parse_search('data "machine learning" -senior or python') == [[(True, "data"), (True, "machine learning"), (False, "senior")], [(True, "python")]]
    df = spark.createDataFrame([(1, "Data Engineer", "machine learning"), (2, "Senior data", "machine learning"), (3, "x", "python"), (4, "x", "y")], "id int, a string, b string")
    fields = [F.col("a"), F.col("b")]
    found = lambda q: {r.id: r["rank"] for r in search.ranked(df, fields, q).collect()}
    assert found('data "machine learning" -senior or python') == {1: 1.4, 3: 0.4}
    assert found("-data -pythons") == {4: 0.0} and found("") == {} and found("engineers machined") == {}
    assert found("engineering") == found("engineers") == {1: 1.0}


def test_near_duplicates_equal_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(90):
        base = random.Random(i % 12).sample(words, 14)
        rows.append((i, f"s{rnd.randint(0, 3)}", f"b{i % 3}", " ".join(w for w in base if rnd.random() < 0.9)))
    df = spark.createDataFrame(rows, "id long, source string, block string, text string")
    got = {(r.a, r.b) for r in similar.near_duplicates(df, "id", F.col("block"), "source", "text").collect()}
    sets = {i: set(t.split()) for i, _, _, t in rows}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] != b[1] and a[2] == b[2] and sets[a[0]] and sets[b[0]] and len(sets[a[0]] & sets[b[0]]) / len(sets[a[0]] | sets[b[0]]) >= 0.6}
    assert got == want and want
    clusters = {r.vertex: r.component for r in components(spark.createDataFrame(sorted(want), "a long, b long")).collect()}
    assert all(clusters[a] == clusters[b] for a, b in want) and all(clusters[v] <= v for v in clusters)


def test_components_of_hubs_chains_and_pairs(spark):
    links = [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 1000), (7, 8), (8, 7), (9, 9)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {5: 5, 1000: 5, 7: 7, 8: 7} | {i: 5 for i in range(1001, 1400)} | {i: 2000 for i in range(2000, 2041)}
    assert got == want
    names = components(spark.createDataFrame([(bytearray(b"b"), bytearray(b"a")), (None, bytearray(b"c"))], "a binary, b binary")).collect()
    assert {(bytes(r.vertex), bytes(r.component)) for r in names} == {(b"a", b"a"), (b"b", b"a")}
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def test_ranks_of_wide_rows_over_small_partitions(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")).dropDuplicates(["k"])
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        ranked = {r.k: r._rank for r in schedule.rank_all(rows, "k").select("k", "_rank").collect()}
        whole = schedule.rank_all(rows, "k").agg(F.count("l_shipdate")).first()[0]
        slices = {r.k: r.shard for r in schedule.shard(rows, "k", 7).select("k", "shard").collect()}
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    order = sorted(ranked)
    assert whole == len(order) == rows.count() and [ranked[k] for k in order] == list(range(1, len(order) + 1))
    size, longer = divmod(len(order), 7)
    assert [slices[k] for k in order] == [i for i in range(7) for _ in range(size + (i < longer))]
    assert schedule.shard(rows.where("k < 0"), "k", 7).count() == 0


def test_breaker_rules():
    fresh = {"status": "closed", "opened": 0.0, "streak": 0, "last": []}

    def feed(outcomes, state=fresh, at=0.0):
        for x in outcomes:
            state = events.breaker_step(state, x, at)
        return state

    assert feed([True] * 15)["status"] == "open"
    assert feed([True, False, False] * 8)["status"] == "open"
    assert feed([True, False] * 9)["status"] == "closed"
    tripped = feed([True] * 15)
    assert events.breaker_step(tripped, False, 10)["status"] == "open"
    assert events.breaker_step(tripped, False, 3600)["status"] == "closed"
    assert events.breaker_step(tripped, True, 3600)["status"] == "open"


def test_paces(spark, tmp_path):
    fresh = {"base": 2.0, "rate": 2.0, "refusals": 0, "until": 0.0}
    once = events.pace_step(fresh, True, 100.0)
    assert (once["rate"], once["until"]) == (1.0, 110.0)
    twice = events.pace_step(once, True, 100.0, 700.0)
    assert (twice["rate"], twice["until"], twice["refusals"]) == (0.5, 800.0, 2)
    state = twice
    for _ in range(12):
        state = events.pace_step(state, True, 0.0, 5000.0)
    assert (state["rate"], state["until"]) == (0.05, 900.0)
    assert events.pace_step(twice, False, 1.0)["rate"] == 0.6 and events.pace_step({**fresh, "rate": 1.9}, False, 1.0)["rate"] == 2.0
    rows = [("h", i, float(i), i < 2, None, 2.0) for i in range(3)] + [("k", 0, 5.0, False, 3.0, 1.0)]
    spark.createDataFrame(rows, "host string, seq long, at double, limited boolean, asked double, base double").write.parquet(str(tmp_path / "in"))
    stream, got = spark.readStream.schema("host string, seq long, at double, limited boolean, asked double, base double").parquet(str(tmp_path / "in")), {}
    events.paces(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.update({r.host: (r.rate, r.refusals, r.until) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert got == {"h": (0.6, 0, 21.0), "k": (1.0, 0, 0.0)}


def test_streams(spark, tmp_path):
    rows = [(i % 8, f"u{i % 3}", dt.datetime(2026, 1, 1 + i // 8, i % 8)) for i in range(24)] + [(99, "late", dt.datetime(2026, 3, 1))]
    spark.createDataFrame(rows, "event_id long, user string, ts timestamp").repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = events.read_stream(spark, str(tmp_path / "in"), "event_id long, user string, ts timestamp")
    events.run_available(events.distinct(stream, ["event_id"], delay="90 days"), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c1"))
    assert sorted(r.event_id for r in seen) == [*range(8), 99]
    counts = []
    events.run_available(events.tumbling_counts(stream, ["user"], delay="60 days"), lambda df, _: counts.extend(df.collect()), str(tmp_path / "c2"))
    assert all(c.n > 0 for c in counts)
    out = [("p", i, float(i), True) for i in range(15)] + [("q", i, float(i), False) for i in range(3)]
    spark.createDataFrame(out, "platform string, seq long, at double, failed boolean").write.parquet(str(tmp_path / "o"))
    states = {}
    rows = spark.readStream.schema("platform string, seq long, at double, failed boolean").parquet(str(tmp_path / "o"))
    query = events.breakers(rows).writeStream.outputMode("update").foreachBatch(lambda df, _: states.update({r.platform: r.status for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert states == {"p": "open", "q": "closed"}
