"""Aggregates over postings, targets, runs and trackers; each reads its table once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def company_rollup(jobs: DataFrame, keys: list[str], seen: str) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(seen).alias("latest"))


def one_pass(df: DataFrame, counts: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """Conditional counts and distinct counts as one row."""
    out = [F.count_if(c).alias(n) for n, c in counts.items()] + [F.count_distinct(c).alias(n) for n, c in (distinct or {}).items()]
    return df.agg(F.count(F.lit(1)).alias("total"), *out)


def coverage(targets: DataFrame, group: Column, success: str, now: Column, days: float = 14) -> DataFrame:
    """By group: targets, never reached, not reached within days, oldest success."""
    aged = F.col(success) < now - F.make_dt_interval(secs=F.lit(days * 86_400))
    return targets.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(success).isNull()).alias("never"), F.count_if(aged).alias("aged"), F.min(success).alias("oldest"))


RUN_SUMMARY = "platforms map<string,struct<attempted:long,succeeded:long,failed:long,jobs_fetched:long,timeouts:long>>, failure_breakdown map<string,map<string,long>>"
#: Failure classes that are the infrastructure's.
INFRASTRUCTURE = ("rate_limited", "anti_bot", "timeout", "connection")


def platform_health(runs: DataFrame, summary: str = "summary_json") -> DataFrame:
    """Sums and rates by platform over JSON run summaries; rates are null without attempts, unreadable summaries are skipped.

    A summary is parsed once and becomes a row a platform and a row a platform's failures; platforms that only have
    failures are left out.
    """
    counts = ("attempted", "succeeded", "failed", "jobs_fetched")
    zero = F.lit(0).cast("long")

    def entry(platform: Column, of: Column | None, infra: Column) -> Column:
        return F.struct(platform.alias("platform"), F.lit(of is not None).alias("run"), *[(zero if of is None else F.coalesce(of[c], zero)).alias(c) for c in counts], infra.alias("infra"))

    def infrastructure(kinds: Column) -> Column:
        ours = F.map_values(F.map_filter(kinds, lambda k, n: k.isin(*INFRASTRUCTURE)))
        return F.aggregate(F.coalesce(ours, F.array().cast("array<bigint>")), zero, lambda a, n: a + F.coalesce(n, zero))

    platforms = F.transform(F.map_entries("s.platforms"), lambda e: entry(e["key"], e["value"], zero))
    failures = F.transform(F.map_entries("s.failure_breakdown"), lambda e: entry(e["key"], None, infrastructure(e["value"])))
    parsed = runs.select(F.from_json(summary, RUN_SUMMARY).alias("s"))  # an unreadable summary has no items
    items = parsed.select(F.explode(F.array(platforms, failures)).alias("some")).select(F.inline("some"))
    sums = items.groupBy("platform").agg(F.max("run").alias("run"), *[F.sum(c).alias(c) for c in (*counts, "infra")]).where("run")
    rate = lambda c: F.bround(c / F.nullif(F.col("attempted"), F.lit(0)), 4)
    return sums.select("platform", "attempted", "succeeded", "failed", "jobs_fetched", rate(F.col("succeeded")).alias("success_rate"), rate(F.col("failed")).alias("error_rate"), rate(F.col("infra")).alias("infra_rate"))


def run_health(runs: DataFrame, scraper: str = "scraper", new: str = "jobs_new", seconds: str = "duration_seconds", failed: str = "failed") -> DataFrame:
    """Runs, new rows, mean seconds, failures and a label by scraper."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col(failed))
    label = F.when(bad == 0, "Healthy").when(bad < n, "Flaky").otherwise("Down")
    return runs.groupBy(scraper).agg(n.alias("runs"), F.sum(new).alias("new_rows"), F.avg(seconds).alias("mean_seconds"), bad.alias("failures"), label.alias("health"))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """How many rows pass each step and all before it, in one pass."""
    passed, out = F.lit(True), []
    for name, step in steps.items():
        passed = passed & F.coalesce(step, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.agg(F.count(F.lit(1)).alias("fetched"), *out)


def pipeline_percent(df: DataFrame, stage: str) -> DataFrame:
    """Rows by stage and their share of all in percent, rounded; one global aggregate over the few stages."""
    from pyspark.sql import Window

    counts = df.groupBy(stage).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(stage, "n", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 0).cast("long").alias("percent"))


def failures(df: DataFrame, platform: str, kind: str) -> DataFrame:
    """Counts by (platform, kind), by platform and overall in one grouping-sets aggregate; level tells them apart."""
    sets = df.groupingSets([[F.col(platform), F.col(kind)], [F.col(platform)], []], F.col(platform), F.col(kind))
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


def with_total(df: DataFrame, key: str, total: str = "All Roles") -> DataFrame:
    """Counts by key and a row for the total."""
    out = df.rollup(key).agg(F.grouping(key).alias("_g"), F.count(F.lit(1)).alias("n"))
    return out.select(F.when(F.col("_g") == 1, total).otherwise(F.col(key)).alias(key), "n")


def dedupe_longest(df: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """One row a key: how many there were and the longest name, of equal lengths the first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_count"), F.max_by(name, F.struct(F.length(name), -F.col(order))).alias(name))


def id_fingerprint(df: DataFrame, key: str, ident: str) -> DataFrame:
    """12 hex digits over a key's sorted ids."""
    return df.groupBy(key).agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_list(F.col(ident).cast("string"))), "|")), 1, 12).alias("fingerprint"))


def alerts(error_rate: Column, queue: Column, blocked: Column, bad_targets: Column, hours_since: Column) -> Column:
    """Names of alerts that hold."""
    checks = (("error_rate_critical", error_rate > 0.15), ("error_rate_warning", (error_rate > 0.05) & (error_rate <= 0.15)), ("queue_backlog", queue > 100), ("anti_bot", blocked > 0), ("bad_targets", bad_targets > 0), ("stale", hours_since > 6))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
