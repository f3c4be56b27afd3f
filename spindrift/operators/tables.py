"""Next-state functions of tables: upserts, stale rows, retention, trackers. All take and return DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], *, replace: list[str], fill: list[str], order: list[Column], inserted: dict[str, Column] | None = None, touched: dict[str, Column] | None = None) -> DataFrame:
    """The next table and is_new: one full join on the key.

    Of incoming rows of one key the first counts. replace takes the new value where there is one, fill keeps the old
    one unless it is null or blank, inserted sets columns of new rows and touched of seen ones.
    """
    incoming = first_rows(incoming, keys, order)
    old, new = current.alias("old"), incoming.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    seen_new, seen_old = F.col("new._in").isNotNull(), F.col("old._in").isNotNull()
    joined = current.withColumn("_in", F.lit(1)).alias("old").join(incoming.withColumn("_in", F.lit(1)).alias("new"), on, "full_outer")
    out = []
    types = dict(old.dtypes)
    for c in current.columns:
        before, after = F.col(f"old.{c}"), F.col(f"new.{c}") if c in new.columns else F.lit(None)
        if c in keys:
            value = F.coalesce(before, after)
        elif c in replace:
            value = F.when(seen_old, F.coalesce(after, before)).otherwise(after)
        elif c in fill:
            value = F.coalesce(F.nullif(before, F.lit("")) if types[c] == "string" else before, after)
        else:
            value = F.when(seen_old, before).otherwise(after)
        if touched and c in touched:
            value = F.when(seen_old & seen_new, touched[c]).otherwise(value)
        if inserted and c in inserted:
            value = F.when(~seen_old, inserted[c]).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out, (~seen_old).alias("is_new"))


def stale(current: DataFrame, latest: DataFrame, key: str, scope: list[str], fetched: DataFrame | None = None) -> DataFrame:
    """Rows in the scopes that were fetched but, by scope and key, not in the latest fetch.

    fetched lists the scopes, those that came back empty too; without it a scope counts as fetched if it has a row.
    """
    scopes = (latest if fetched is None else fetched).select(*scope).distinct()
    return current.join(scopes, scope, "left_semi").join(latest.select(*scope, key), [*scope, key], "left_anti")


def compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(change, n): keys added, removed and common, in one full join."""
    a, b = old.select(F.col(key).alias("a")).distinct(), new.select(F.col(key).alias("b")).distinct()
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("common")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def merge_fingerprints(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Long-lived memory of postings by internal_hash: last_seen is the newest, posted_at and source stay unless new ones are given, first_seen the oldest."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)

    def latest(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("_new")))

    return both.groupBy("internal_hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), latest(F.col("posted_at")).alias("posted_at"), latest(F.nullif(F.col("source"), F.lit(""))).alias("source"))


@dataclass(frozen=True)
class Limits:
    """Days after which rows go, and hours after which unposted ones are archived."""

    archive_hours: int = 72
    clear_description: int = 3
    rejected: int = 3
    needs_review: int = 3
    archived: int = 7
    inactive_accepted: int = 30
    inactive: int = 7
    fingerprint: int = 180
    runs: int = 500


def retention_reason(now: Column, limits: Limits = Limits(), *, status: str = "status", state: str = "quality_state", active: str = "is_active", last_seen: str = "last_seen_at", first_seen: str = "first_seen") -> Column:
    """Why a row is deleted, by the first rule that holds, or null. Ages run from last_seen, else first_seen."""
    age = F.coalesce(last_seen, first_seen)

    def older(days: int) -> Column:
        return F.coalesce(age < now - F.make_dt_interval(F.lit(days)), F.lit(False))

    quality = F.coalesce(state, F.lit("needs_review"))
    return (
        F.when((quality == "rejected") & older(limits.rejected), "rejected")
        .when((quality == "needs_review") & older(limits.needs_review), "needs_review")
        .when((F.col(status) == "archived") & older(limits.archived), "archived")
        .when(~F.col(active) & (quality == "accepted") & older(limits.inactive_accepted), "inactive_accepted")
        .when(~F.col(active) & (quality != "accepted") & older(limits.inactive), "inactive")
    )


def archive(jobs: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Unposted rows first seen longer ago become archived."""
    old = (F.col("status") == "unposted") & (F.col("first_seen") < now - F.make_dt_interval(hours=F.lit(hours)))
    return jobs.withColumn("status", F.when(old, "archived").otherwise(F.col("status")))


def retain(jobs: DataFrame, now: Column, limits: Limits = Limits(), longest: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts by reason): archive, cap and clear descriptions, then delete; one pass marks every row."""
    from spindrift.functions.text import description

    jobs = archive(jobs, now, limits.archive_hours).withColumn("description", description(F.col("description"), longest))
    age = F.coalesce("last_seen_at", "first_seen")
    clear = age < now - F.make_dt_interval(F.lit(limits.clear_description))
    jobs = jobs.withColumn("description", F.when(F.coalesce(clear, F.lit(False)), F.lit("")).otherwise(F.col("description")))
    marked = jobs.withColumn("_reason", retention_reason(now, limits))
    counts = marked.where(F.col("_reason").isNotNull()).groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return marked.where(F.col("_reason").isNull()).drop("_reason"), counts


def keep_last(runs: DataFrame, key: str, order: str, n: int = 500) -> DataFrame:
    """The newest n rows of each key."""
    return first_rows(runs, [key], [F.col(order).desc()], n)


def mark_posted(jobs: DataFrame, posted: DataFrame, key: str = "internal_hash") -> DataFrame:
    hit = posted.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return jobs.join(hit, F.col(key) == F.col("_k"), "left").withColumn("status", F.when(F.col("_hit"), "posted").otherwise(F.col("status"))).drop("_k", "_hit")


def track(applications: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Tracker rows (user_id, job_hash, stage, applied_at) after updates; applied_at is set once, at the first applied."""
    both = applications.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rows = both.groupBy("user_id", "job_hash").agg(F.max_by("stage", "_new").alias("stage"), F.min("applied_at").alias("applied_at"))
    return rows.withColumn("applied_at", F.coalesce("applied_at", F.when(F.col("stage") == "applied", now)))


def visit(targets: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Targets after a round of visits (ats_type, slug, job_count, relevant_count, failed): counters, tier, health, next due, lease cleared."""
    from spindrift.functions.classify import next_due_seconds

    seen = targets.join(outcomes, ["ats_type", "slug"], "left")
    came, failed = F.col("failed").isNotNull(), F.coalesce("failed", F.lit(False))
    found, relevant = F.coalesce("job_count", F.lit(0)), F.coalesce("relevant_count", F.lit(0))
    failures = F.when(came & failed, F.col("consecutive_failures") + 1).when(came, 0).otherwise(F.col("consecutive_failures"))
    tier = F.when(came & (relevant > 0) & F.col("tier").isin("P2", "P3"), "P1").when(came & ~failed & (found == 0) & (F.col("tier") == "P2") & (F.col("total_scrapes") >= 10), "P3").otherwise(F.col("tier"))
    seen = seen.withColumn("consecutive_failures", failures).withColumn("tier", tier)
    seen = seen.withColumn("total_scrapes", F.col("total_scrapes") + came.cast("int")).withColumn("total_jobs_found", F.col("total_jobs_found") + found).withColumn("total_relevant_jobs_found", F.col("total_relevant_jobs_found") + relevant)
    n = F.col("consecutive_failures")
    health = F.when(n >= 10, "dead").when(n >= 2, "degraded").otherwise("healthy")
    due = now + F.make_dt_interval(secs=next_due_seconds(F.col("tier"), n, found, relevant, failed))
    seen = seen.withColumn("health_state", F.when(came, health).otherwise(F.col("health_state"))).withColumn("is_dead", F.when(came, n >= 10).otherwise(F.col("is_dead").cast("boolean")))
    seen = seen.withColumn("next_due_at", F.when(came, due).otherwise(F.col("next_due_at"))).withColumn("last_job_found_at", F.when(came & (found > 0), now).otherwise(F.col("last_job_found_at"))).withColumn("last_success_at", F.when(came & ~failed, now).otherwise(F.col("last_success_at")))
    return seen.withColumn("lease_until", F.when(came, F.lit(None)).otherwise(F.col("lease_until"))).withColumn("lease_owner", F.when(came, F.lit(None)).otherwise(F.col("lease_owner"))).select(targets.columns)
