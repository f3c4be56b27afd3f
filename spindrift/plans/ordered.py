"""Queries over rows in order: breakers folded over visits, breakers and retries as streams with timers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import fold
from spindrift.plans.catalog import QUERIES, SQL, query, streamed
from spindrift.scratch import scratch_path
from spindrift.streaming import timers
from spindrift.streaming.events import read_stream, run_available
from spindrift.streaming.ledger import Ledger


@query("""
WITH RECURSIVE v AS (SELECT lang, doc_id, length(text) < 700 AS failed, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
f AS (SELECT lang, doc_id, n, failed::INTEGER AS streak, [failed::INTEGER] AS recent, NULL::INTEGER AS skip, true AS visited FROM v WHERE n = 1
UNION ALL
SELECT lang, doc_id, n, streak, recent, CASE WHEN NOT visited THEN skip - 1 WHEN failed AND skip IS NULL AND (streak >= 15 OR share >= 0.3) THEN 50 WHEN NOT failed AND share < 0.3 THEN NULL ELSE skip END, visited
FROM (SELECT *, CASE WHEN len(recent) >= 20 THEN list_sum(recent)::DOUBLE / len(recent) ELSE 0 END AS share
  FROM (SELECT v.lang, v.doc_id, v.n, v.failed, f.skip, coalesce(f.skip, 0) = 0 AS visited, CASE WHEN coalesce(f.skip, 0) > 0 THEN f.streak WHEN v.failed THEN f.streak + 1 ELSE 0 END AS streak,
    CASE WHEN coalesce(f.skip, 0) > 0 THEN f.recent ELSE list_slice(list_append(f.recent, v.failed::INTEGER), -50, -1) END AS recent FROM f JOIN v ON v.lang = f.lang AND v.n = f.n + 1)))
SELECT lang, doc_id, visited, CASE WHEN skip IS NULL THEN 'closed' WHEN skip > 0 THEN 'open' ELSE 'half_open' END AS status FROM f
""")
def breaker_fold(read):
    """Each language's documents in order as visits of a platform, short ones as failures: which a breaker lets through, and its status."""
    visits = read("documents").select("lang", "doc_id", (F.length("text") < 700).alias("failed"))
    return fold.breakers(visits, ["lang"], ["doc_id"])


def _timed(spark: SparkSession, sf_dir: str, name: str, flow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream over events with its state in the store that has timers; the session's own store comes back afterwards."""
    (key, store), = timers.STORE.items()
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        return streamed(spark, sf_dir, name, flow)
    finally:
        spark.conf.set(key, before)


def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When users' retries fall due, errors as failures and purchases as successes."""

    def flow(s: DataFrame) -> DataFrame:
        mine = s.where(F.col("event_type").isin("error", "purchase")).withWatermark("ts", "1 hour")
        rows = mine.select("ts", F.col("user_id").cast("string").alias("target"), timers.millis("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("double").alias("asked"))
        return timers.retries(rows)

    return _timed(spark, sf_dir, "stream-retries", flow)


def stream_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of users' breakers, errors as failures."""

    def flow(s: DataFrame) -> DataFrame:
        return timers.breaker_changes(s.withWatermark("ts", "1 hour").select("ts", F.col("user_id").cast("string").alias("platform"), timers.millis("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed")))

    return _timed(spark, sf_dir, "stream-breakers", flow)


def stream_posted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event of a kind, posted once by a sink with a ledger; the stream is run twice."""
    path = scratch_path(spark, "stream-posts")
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    schema = source.schema.simpleString()[7:-1].replace(":", " ")
    post = Ledger(f"{path}/ledger").sink(F.concat_ws(":", "user_id", "event_type"), [F.col("ts"), F.col("event_id")], time.time)
    for _ in range(2):
        stream = read_stream(spark, f"{sf_dir}/events.parque[t]", schema, most_files=None)
        run_available(stream, post, f"{path}/state")
    found = Ledger(f"{path}/ledger").posted(spark, stream.schema.simpleString()[7:-1].replace(":", " "))
    return found.select("event_id", "user_id", "event_type")


QUERIES |= {"stream_posted_once": stream_posted_once, "stream_retries": stream_retries, "stream_breakers": stream_breakers}
SQL |= {
    "stream_posted_once": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "stream_retries": """
WITH e AS (SELECT user_id::VARCHAR AS target, epoch_us(ts) // 1000 AS at_, event_id, event_type = 'error' AS failed FROM events WHERE event_type IN ('error', 'purchase')),
g AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER w AS streak, lead(at_) OVER w AS next FROM e WINDOW w AS (PARTITION BY target ORDER BY at_, event_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY target, streak ORDER BY at_, event_id) - 1 AS k FROM g WHERE failed),
d AS (SELECT target, next, (k % 3)::INTEGER AS attempt, at_ + CASE WHEN k = 0 THEN 3600000 WHEN k % 3 = 1 THEN 21600000 WHEN k % 3 = 2 THEN 86400000 ELSE 604800000 END AS due FROM k)
SELECT target, due, attempt FROM d WHERE (next IS NULL OR next >= due) AND (next IS NOT NULL OR due <= (SELECT max(at_) - 3600000 FROM e))
""",
    "stream_breakers": """
WITH RECURSIVE v AS (SELECT user_id, epoch_us(ts) // 1000 AS at_, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'closed' AS status, 0::BIGINT AS opened, 0 AS streak, []::INTEGER[] AS last, []::STRUCT(at_ BIGINT, status VARCHAR, streak INTEGER)[] AS changes FROM v
UNION ALL
SELECT user_id, n, status, opened, streak, last, list_concat(CASE WHEN waited THEN [struct_pack(at_ := before + 3600000, status := 'half_open', streak := had)] ELSE [] END, CASE WHEN status <> tried THEN [struct_pack(at_ := at_, status := status, streak := streak)] ELSE [] END) FROM (
  SELECT user_id, n, at_, waited, before, had, tried, streak, CASE WHEN tried = 'half_open' THEN [] ELSE last END AS last,
  CASE WHEN tried = 'open' THEN 'open' WHEN tried = 'half_open' THEN CASE WHEN failed THEN 'open' ELSE 'closed' END WHEN streak >= 15 OR len(last) >= 20 AND list_sum(last)::DOUBLE / len(last) >= 0.3 THEN 'open' ELSE 'closed' END AS status,
  CASE WHEN tried = 'open' THEN before WHEN tried = 'half_open' THEN CASE WHEN failed THEN at_ ELSE 0 END WHEN streak >= 15 OR len(last) >= 20 AND list_sum(last)::DOUBLE / len(last) >= 0.3 THEN at_ ELSE 0 END AS opened FROM (
    SELECT *, CASE WHEN tried = 'open' THEN had WHEN tried = 'half_open' THEN CASE WHEN failed THEN had ELSE 0 END WHEN failed THEN had + 1 ELSE 0 END AS streak,
    CASE WHEN tried = 'closed' THEN list_slice(list_append(earlier, failed::INTEGER), -50, -1) ELSE earlier END AS last FROM (
      SELECT v.user_id, v.n, v.at_, v.failed, f.opened AS before, f.streak AS had, f.last AS earlier, f.status = 'open' AND v.at_ >= f.opened + 3600000 AS waited,
      CASE WHEN f.status = 'open' AND v.at_ >= f.opened + 3600000 THEN 'half_open' ELSE f.status END AS tried FROM f JOIN v ON v.user_id = f.user_id AND v.n = f.n + 1)))),
ended AS (SELECT user_id, arg_max(status, n) AS status, arg_max(opened, n) AS opened, arg_max(streak, n) AS streak FROM f GROUP BY 1)
SELECT user_id::VARCHAR AS platform, c.at_ AS at, c.status AS status, c.streak AS streak FROM (SELECT user_id, unnest(changes) AS c FROM f)
UNION ALL SELECT user_id::VARCHAR, opened + 3600000, 'half_open', streak FROM ended WHERE status = 'open' AND opened + 3600000 <= (SELECT max(epoch_us(ts) // 1000) - 3600000 FROM events)
""",
}
