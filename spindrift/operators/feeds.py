"""What is pushed next and what is known of targets: candidates, batches, validation records, metadata, run stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import classify

METADATA = "map<string,string>"


def _since(now: Column, hours: float) -> Column:
    return now - F.make_dt_interval(secs=F.lit(hours * 3600))


def within_ttl(targets: DataFrame, now: Column, days: int = 30, tier: str = "tier", last: str = "last_job_found_at") -> DataFrame:
    """Targets of tier P0, and others whose last find is not older than days; those without a find stay."""
    return targets.where((F.col(tier) == "P0") | F.col(last).isNull() | (F.col(last) >= _since(now, 24 * days)))


def unposted_candidates(jobs: DataFrame, now: Column, hours: int = 24, limit: int = 1000, direct_only: bool = True, least: int = 200) -> DataFrame:
    """Active unposted rows first seen within hours, newest first, up to limit (least at the least); direct_only keeps accepted ones."""
    rows = jobs.where((F.col("status") == "unposted") & F.col("is_active") & (F.col("first_seen") >= _since(now, max(1, hours))))
    if direct_only:
        rows = rows.where(F.coalesce("quality_state", F.lit("needs_review")) == "accepted")
    return rows.orderBy(F.col("first_seen").desc(), "internal_hash").limit(max(least, limit))


def push_batch(jobs: DataFrame, n: int = 75) -> DataFrame:
    """The n best rows by score; of equal scores the newest come first."""
    return jobs.orderBy(F.col("quality_score").desc(), F.col("first_seen").desc(), "internal_hash").limit(n)


def recent_accepted(jobs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Active accepted rows of the last hours with rank: best first, of equal scores the newest.

    The rank of a row is one more than the rows before it, from range partitions (schedule.rank_all), so it needs no
    task that holds all rows.
    """
    from spindrift.operators.schedule import rank_all

    rows = jobs.where(F.col("is_active") & (F.coalesce("quality_state", F.lit("needs_review")) == "accepted") & (F.col("first_seen") >= _since(now, hours)))
    placed = rows.withColumn("_order", F.struct((-F.col("quality_score")).alias("s"), (-F.unix_micros(F.col("first_seen").cast("timestamp"))).alias("t"), "internal_hash"))
    return rank_all(placed, "_order").drop("_order").withColumnRenamed("_rank", "rank")


def least_validated(targets: DataFrame, limit: int, checked: str = "validation_checked_at") -> DataFrame:
    """Targets whose check is missing or oldest."""
    return targets.orderBy(F.col(checked).asc_nulls_first(), "ats_type", "slug").limit(limit)


def latest_run(runs: DataFrame, by: str = "run_at", last: str = "run_id") -> DataFrame:
    """The newest row, by one aggregate."""
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct(by, last)).alias("r")).select("r.*")


def next_shard(cursors: DataFrame, name: str, shards: int) -> DataFrame:
    """Cursors (name, n) after one more turn of name, and shard (n - 1 modulo shards) on its row."""
    turn = cursors.sparkSession.createDataFrame([(name, 1)], "name string, n long")
    out = cursors.unionByName(turn).groupBy("name").agg(F.sum("n").alias("n"))
    return out.withColumn("shard", F.when(F.col("name") == name, F.pmod(F.col("n") - 1, F.lit(shards)).cast("int")))


def shuffled(targets: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """place of each row in its group's random order; one seed gives one order."""
    return targets.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)))


def unposted(jobs: DataFrame, posted: DataFrame, key: str = "internal_hash") -> DataFrame:
    """Rows whose hash was not posted yet."""
    return jobs.join(posted.select(key), key, "left_anti")


def hits_with_rows(hits: DataFrame, rows: DataFrame, hit_key: str, key: str, k: int, similarity: str = "similarity") -> DataFrame:
    """The k most similar of the hits that have a row; callers fetch three times k hits."""
    return hits.join(rows, F.col(hit_key) == F.col(key)).orderBy(F.col(similarity).desc(), hit_key).limit(k)


def embedding_text(title: Column, company: Column, location: Column, description: Column, categories: Column, longest: int = 2000) -> Column:
    """The labelled parts of a posting that are not empty, joined by bars; descriptions are cut."""

    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(F.length(value), F.lit(0)) > 0, F.concat(F.lit(f"{label}: "), value))

    return F.concat_ws(" | ", part("Title", title), part("Company", company), part("Location", location), part("Description", F.substring(description, 1, longest)), part("Category", F.array_join(categories, ", ")))


def freshness_minutes(first_seen: Column, now: Column) -> Column:
    """Whole minutes since a row was first seen, halves to even; null without a time."""
    return F.bround((F.unix_micros(now) - F.unix_micros(first_seen)) / 60_000_000, 0).cast("long")


def training_rows(jobs: DataFrame) -> DataFrame:
    """Rows that salary estimates may be built from."""
    return jobs.where(F.col("is_active") & (F.col("salary_min") > 10_000) & (F.col("salary_max") > 10_000) & (F.col("salary_currency") == "USD"))


def per_target(jobs: DataFrame, keys: list[str], relevant: Column) -> DataFrame:
    """Raw and relevant rows of each target."""
    return jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw"), F.count_if(relevant).alias("relevant"))


def company_groups(jobs: DataFrame, company: str, seen: str, ident: str) -> DataFrame:
    """(company, latest, n, rows): a company's rows newest first as (seen, id); ordering by latest gives the page of groups."""
    item = F.struct((-F.unix_micros(F.col(seen).cast("timestamp"))).alias("age"), F.col(ident).alias("id"))
    out = jobs.groupBy(company).agg(F.max(seen).alias("latest"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("rows"))
    return out.withColumn("rows", F.col("rows.id"))


def distribution(df: DataFrame, value: Column, n: int | None = None) -> DataFrame:
    """(value, n) by descending count, the first n values if given."""
    out = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col("n").desc(), "value").limit(n) if n else out


def metadata(text: Column) -> Column:
    """The map in a JSON text; unreadable and missing ones are empty."""
    return F.coalesce(F.from_json(text, METADATA), F.create_map().cast(METADATA))


def _sorted_json(values: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def merge_metadata(text: Column, new: Column) -> Column:
    """JSON of the old map and the new one over it, keys in order."""
    old = F.map_filter(metadata(text), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return _sorted_json(F.map_concat(old, new))


def remove_metadata(text: Column, key: str) -> Column:
    return _sorted_json(F.map_filter(metadata(text), lambda k, _: k != key))


def cached_target(ats: Column, slug: Column, meta: Column, supported: list[str]) -> Column:
    """(ats, slug, used): where a target was found to be: a resolved board and slug, or a Workday site put in the slug's place."""
    values = metadata(meta)
    ats, slug = F.lower(F.coalesce(ats, F.lit(""))), F.coalesce(slug, F.lit(""))
    board, name, site = F.lower(F.trim(F.coalesce(values["resolved_ats"], F.lit("")))), F.trim(F.coalesce(values["resolved_slug"], F.lit(""))), F.coalesce(values["workday_site"], F.lit(""))
    resolved = (name != "") & board.isin(supported)
    parts = F.split(slug, ":")
    moved = ~resolved & (ats == "workday") & (site != "") & (F.size(parts) == 3)
    to_ats = F.when(resolved, board).otherwise(ats)
    to_slug = F.when(resolved, name).when(moved, F.concat_ws(":", F.get(parts, 0), F.get(parts, 1), site)).otherwise(slug)
    return F.struct(to_ats.alias("ats"), to_slug.alias("slug"), ((to_ats != ats) | (to_slug != slug)).alias("used"))


#: Failures in a row after which a target is quarantined: bad addresses, other failures.
QUARANTINE = (3, 10)


def record_validation(targets: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Targets after live checks (ats_type, slug, status, category, http_status).

    A good result resets failures and pulls a later due time to now; a bad one counts up and puts the target off, and
    from 3 (bad addresses) or 10 failures on it is quarantined.
    """
    seen = targets.join(results, ["ats_type", "slug"], "left")
    came, good = F.col("status").isNotNull(), F.coalesce(F.col("status") == "ok", F.lit(False))
    bad_target = (F.col("category") == "bad_target") | (F.col("status") == "bad_target")
    n = F.when(~came, F.col("consecutive_failures")).when(good, 0).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + 1)
    out = seen.withColumn("consecutive_failures", n.cast("int"))
    n = F.col("consecutive_failures")
    out_of_use = came & ~good & (n >= F.when(bad_target, QUARANTINE[0]).otherwise(QUARANTINE[1]))
    later = now + F.make_dt_interval(secs=classify.next_due_seconds(F.col("tier"), n, F.lit(0), F.lit(0), F.lit(True)))
    due = F.when(~came, F.col("next_due_at")).when(good, F.when(F.col("next_due_at").isNull() | (F.col("next_due_at") > now), now).otherwise(F.col("next_due_at"))).otherwise(later)
    health = F.when(~came, F.col("health_state")).when(good, "healthy").when(out_of_use, "quarantined").otherwise("degraded")
    dead = F.when(came & good, False).otherwise(F.coalesce(F.col("is_dead").cast("boolean"), F.lit(False)) | F.coalesce(out_of_use, F.lit(False)))
    return out.withColumns({"next_due_at": due, "health_state": health, "is_dead": dead, "validation_status": F.col("status"), "validation_checked_at": F.when(came, now)}).drop("status", "category", "http_status")


def force_tier(targets: DataFrame, forced: DataFrame, tier: str = "P0", keys: tuple[str, ...] = ("ats_type", "slug")) -> DataFrame:
    """Targets with the tier set on those listed."""
    hit = forced.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return targets.join(hit, list(keys), "left").withColumn("tier", F.when(F.col("_hit"), F.lit(tier)).otherwise(F.col("tier"))).drop("_hit")


def append_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    """The log with further rows; columns that either side lacks are null."""
    return runs.unionByName(run, allowMissingColumns=True)


def merge_store(store: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """The store and those fetched rows whose key it lacks (of equal keys the first by all columns), and is_new."""
    fresh = fetched.groupBy(key).agg(F.min(F.struct(*[c for c in fetched.columns if c != key])).alias("r")).select(key, "r.*")
    return store.withColumn("is_new", F.lit(False)).unionByName(fresh.join(store.select(key), key, "left_anti").withColumn("is_new", F.lit(True)))


def merge_checkpoint(old: Column, new: Column, at: Column) -> Column:
    """A state map with new values over old ones and the time of the merge."""
    stamped = F.map_concat(F.map_filter(new, lambda k, _: k != "updated_at"), F.create_map(F.lit("updated_at"), at))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(stamped), k)), stamped)


def health_report(health: DataFrame, title: str) -> DataFrame:
    """Markdown lines of a table by platform (platform, attempted, succeeded, failed, success_rate), worst first; place orders them."""
    percent = F.coalesce(F.format_string("%.2f%%", F.col("success_rate") * 100), F.lit("n/a"))
    row = F.format_string("| %s | %d | %d | %d | %s |", "platform", "attempted", "succeeded", "failed", percent)
    order = Window.orderBy(F.col("success_rate").asc_nulls_last(), "platform")  # a row a platform
    lines = health.select((F.row_number().over(order) + 3).alias("place"), row.alias("line"))
    head = [(1, f"## {title}"), (2, "| Platform | Attempted | Succeeded | Failed | Success |"), (3, "|---|---|---|---|---|")]
    return health.sparkSession.createDataFrame(head, "place int, line string").unionByName(lines)
