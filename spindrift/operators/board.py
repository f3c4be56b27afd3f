"""Public board, control and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import classify, text
from spindrift.functions import vocabulary as V

#: Labels of sources; others show their own name with spaces.
SOURCE_LABELS = {"greenhouse": "Greenhouse", "lever": "Lever", "ashby": "Ashby", "workday": "Workday", "workable": "Workable", "rippling": "Rippling", "smartrecruiters": "SmartRecruiters", "bamboohr": "BambooHR", "rss": "RSS", "linkedin": "LinkedIn", "indeed": "Indeed"}


def source_label(source: Column) -> Column:
    known = F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in SOURCE_LABELS.items()])
    return F.when(F.coalesce(source, F.lit("")) == "", "Company Careers").otherwise(F.coalesce(known, F.regexp_replace(source, "[-_]", " ")))


def snapshot(jobs: DataFrame, most: int = 1000) -> DataFrame:
    """The board's rows, newest first: US postings with an address and a sound company, labelled and put in a category."""
    location, source = text.location_label(F.col("location")), source_label(F.col("source_ats"))
    keep = ~F.coalesce(F.col("company"), F.lit("")).rlike(V.BAD_COMPANY) & classify.is_us_strict(location) & (F.coalesce(F.col("url"), F.lit("")) != "")
    return (
        jobs.where(keep)
        .orderBy(F.col("first_seen").desc(), "internal_hash")
        .limit(most)
        .select(
            F.coalesce("internal_hash", "job_id").alias("id"), F.coalesce("title", F.lit("Untitled Role")).alias("title"), classify.board_category(F.coalesce("keywords_matched", F.array().cast("array<string>")), F.col("title")).alias("category"),
            text.company_label(F.col("company"), source).alias("company"), location.alias("location"), F.col("url").alias("application_url"), F.coalesce("date_posted", F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("posted_at"), source.alias("source"),
        )
    )


def back_fill(accepted: DataFrame, others: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Accepted rows first, then others not among them, up to most."""
    fill = others.join(accepted.select(key), key, "left_anti")
    both = accepted.withColumn("_place", F.lit(0)).unionByName(fill.withColumn("_place", F.lit(1)))
    return both.orderBy("_place", *order).limit(most).drop("_place")


def control(targets: DataFrame, now: Column) -> DataFrame:
    """By platform: targets, dead and leased ones, those due, mean score; one pass."""
    dead = F.coalesce(F.col("is_dead").cast("boolean"), F.lit(False))
    due = ~dead & (F.col("next_due_at").isNull() | (F.col("next_due_at") <= now))
    return targets.groupBy(F.lower("ats_type").alias("platform")).agg(F.count(F.lit(1)).alias("total"), F.count_if(dead).alias("dead"), F.count_if(F.col("lease_until") > now).alias("leased"), F.count_if(due).alias("due"), F.bround(F.avg(F.coalesce("scrape_score", F.lit(0.0))), 4).alias("mean_score"))


def top_failing(targets: DataFrame, n: int = 10) -> DataFrame:
    return targets.where("consecutive_failures > 0").orderBy(F.col("consecutive_failures").desc(), "ats_type", "slug").limit(n)


def due_decision(runs: DataFrame, platforms: list[str], now: Column, interval_minutes: int) -> DataFrame:
    """One row: the latest success that covered a platform, and whether another run is due (without one, it is)."""
    covered = F.arrays_overlap(F.map_keys(F.from_json("summary_json", "platforms map<string,string>")["platforms"]), F.array(*map(F.lit, platforms)))
    latest = runs.where(F.col("success") & covered).agg(F.max("run_at").alias("latest"))
    return latest.select("latest", F.coalesce(F.col("latest") <= now - F.make_dt_interval(mins=F.lit(interval_minutes)), F.lit(True)).alias("due"))


def seed(targets: DataFrame, seeds: DataFrame) -> DataFrame:
    """Targets (ats_type, slug, tier, priority_score) with seeds: P0 sticks, the greater priority counts, new ones are added."""
    s = seeds.select("ats_type", "slug", F.col("tier").alias("_tier"), F.col("priority_score").alias("_score"))
    out = targets.join(s, ["ats_type", "slug"], "full_outer")
    tier = F.when(F.col("tier") == "P0", "P0").otherwise(F.coalesce("_tier", "tier"))
    return out.withColumn("tier", tier).withColumn("priority_score", F.greatest("priority_score", "_score")).drop("_tier", "_score")


def fair_claim(candidates: DataFrame, group: str, order: list[Column], caps: DataFrame, limit: int, multiplier: int = 2) -> DataFrame:
    """Up to min(limit, cap * multiplier) rows of each group; caps has (group, cap)."""
    ranked = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    most = F.least(F.lit(limit), F.coalesce(F.col("cap"), F.lit(limit)) * multiplier)
    return ranked.join(caps.select(group, "cap"), group, "left").where(F.col("_n") <= most).drop("_n", "cap")


def retry_union(registry: DataFrame, retries: DataFrame, keys: list[str]) -> DataFrame:
    """The registry and those retries it lacks."""
    return registry.unionByName(retries.join(registry.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def prune(hashes: DataFrame, posted: Column, now: Column, days: int = 7) -> DataFrame:
    """Posted hashes of the last days; unreadable times are kept."""
    return hashes.where(F.coalesce(posted >= now - F.make_dt_interval(F.lit(days)), F.lit(True)))


def digest(jobs: DataFrame, category: Column, n: int = 5) -> DataFrame:
    """Counts of the n largest categories for a short text."""
    return jobs.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category").limit(n)


def exposition(metrics: DataFrame, prefix: str) -> DataFrame:
    """Lines of the Prometheus text format from (name, label, value)."""
    name = F.concat(F.lit(f"{prefix}_"), F.regexp_replace("name", "[^a-zA-Z0-9_]", "_"))
    label = F.when(F.col("label").isNotNull(), F.concat(F.lit('{label="'), F.col("label"), F.lit('"}'))).otherwise("")
    return metrics.select(F.concat(name, label, F.lit(" "), F.col("value").cast("string")).alias("value"))


def all_tokens(haystack: list[Column], query: str) -> Column:
    """Whether every word of a search is somewhere in the fields, without regard to case and marks."""
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9+#.]+", " ")
    hay = clean(F.concat_ws(" ", *haystack))
    hit = F.lit(True)
    for word in query.lower().split():
        hit = hit & hay.contains(word)
    return hit


def experience_bucket(years: Column, title: Column) -> Column:
    level = F.lower(F.coalesce(title, F.lit("")))
    return F.when(years <= 2, "entry").when(years <= 5, "mid").when(years > 5, "senior").when(level.rlike(r"\b(intern|junior|new grad|entry)\b"), "entry").when(level.rlike(r"\b(senior|staff|principal|lead)\b"), "senior").otherwise("mid")


def display_company(company: Column, aliases: dict[str, str] | None = None) -> Column:
    """An alias, or the name with camel case split and role @ company repaired."""
    name = F.trim(F.regexp_replace(F.coalesce(company, F.lit("")), r"^.*@\s*", ""))
    known = [F.when(F.lower(name) == k, F.lit(v)) for k, v in (aliases or {}).items()]
    split = F.initcap(F.regexp_replace(F.regexp_replace(name, r"[-_]+", " "), r"([a-z])([A-Z])", "$1 $2"))
    return F.coalesce(*known, split)
