"""Target registries: validation with reasons, merging, grouped listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import urls
from spindrift.functions.text import bound
from spindrift.sources.boards import BOARDS

SUPPORTED = (*BOARDS, "icims", "jsonld")


def normalise(company: Column, ats: Column, slug: Column) -> Column:
    """(company, ats, slug, reason): addresses become slugs; reason is null for good targets."""
    company, ats, slug = F.trim(F.coalesce(company, F.lit(""))), F.lower(F.trim(F.coalesce(ats, F.lit("")))), F.trim(F.coalesce(slug, F.lit("")))

    def judged(found: Column) -> Column:
        is_url = slug.startswith("http://") | slug.startswith("https://")
        clean = F.when(is_url, found["slug"]).otherwise(slug)
        reason = (
            F.when(slug == "", "missing_slug")
            .when(~ats.isin(*SUPPORTED), "unsupported_ats")
            .when(is_url & found["platform"].isNotNull() & (found["platform"] != ats), "ats_mismatch")
            .when(clean.isNull(), "unrecognised_url")
            .when((ats != "jsonld") & clean.rlike("[ /?#]"), "malformed_slug")
            .when((ats == "workday") & (F.size(F.split(clean, ":")) != 3), "malformed_workday_slug")
        )
        return F.struct(company.alias("company"), ats.alias("ats"), F.when(ats == "jsonld", slug).otherwise(clean).alias("slug"), reason.alias("reason"))

    return bound(urls.target(slug), judged)


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good targets, counts of rejects by reason) of rows (company, ats, slug)."""
    checked = rows.select(normalise(F.col("company"), F.col("ats"), F.col("slug")).alias("x")).select("x.*")
    good = checked.where(F.col("reason").isNull()).drop("reason")
    return good, checked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def read_registry(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(company, ats, slug) of registry JSON in any of three shapes: a list, an object with companies, lists by platform."""
    entry = "array<struct<company:string,name:string,ats:string,ats_type:string,slug:string>>"
    v = F.try_parse_json(column)
    flat = payloads.select(F.explode(F.coalesce(F.try_variant_get(v, "$", entry), F.try_variant_get(v, "$.companies", entry))).alias("e")).select("e.*")
    flat = flat.select(F.coalesce("company", "name").alias("company"), F.coalesce("ats", "ats_type").alias("ats"), "slug")
    grouped = payloads.where(F.try_variant_get(v, "$", entry).isNull() & F.try_variant_get(v, "$.companies", entry).isNull())
    by_platform = grouped.select(F.explode(F.from_json(column, f"map<string,{entry}>")).alias("ats_key", "list")).select("ats_key", F.explode("list").alias("e"))
    return flat.unionByName(by_platform.select(F.coalesce("e.company", "e.name").alias("company"), F.col("ats_key").alias("ats"), F.col("e.slug").alias("slug")))


def merge(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry and those found targets whose (ats, slug) it lacks, each once."""
    fresh = found.join(registry, ["ats", "slug"], "left_anti").dropDuplicates(["ats", "slug"])
    return registry.unionByName(fresh, allowMissingColumns=True)


def merge_csv(registry: DataFrame, csv: DataFrame, name: str = "company", url: str = "url") -> DataFrame:
    """The registry with targets of a CSV of names and board addresses."""
    t = urls.target(F.col(url))
    found = csv.select(F.col(name).alias("company"), t["platform"].alias("ats"), t["slug"].alias("slug")).where(F.col("ats").isNotNull() & F.col("slug").isNotNull())
    return merge(registry, found)


def listing(registry: DataFrame) -> DataFrame:
    """(ats, n, names): platforms by size, their companies sorted and joined."""
    return registry.groupBy("ats").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("company")), ", ").alias("names")).orderBy(F.col("n").desc(), "ats")


def recovered_slug(slug: Column) -> Column:
    """tenant:shard:site of a Workday slug whose site runs on into a path, or null if nothing can be saved."""
    parts = F.split(F.coalesce(slug, F.lit("")), ":")
    site = F.trim(F.regexp_extract(F.get(parts, 2), "^([^/?#]*)", 1))
    sound = (F.size(parts) == 3) & (F.get(parts, 0) != "") & F.get(parts, 1).rlike("^[0-9]+$") & (site != "")
    return F.when(sound, F.concat_ws(":", F.get(parts, 0), F.get(parts, 1), site))


def clean_workday(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, stats) of rows (company, ats, slug): Workday slugs recovered, each once under its longest name; other rows as they are."""
    is_workday = F.lower(F.coalesce("ats", F.lit(""))) == "workday"
    marked = rows.withColumn("_new", F.when(is_workday, recovered_slug(F.col("slug")))).withColumn("_name", F.trim(F.coalesce("company", F.lit(""))))
    kept = marked.where(is_workday & F.col("_new").isNotNull())
    longest = F.max_by("_name", F.struct(F.length("_name"), "_name"))
    once = kept.groupBy(F.col("_new").alias("slug")).agg(longest.alias("name")).select(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("slug")).alias("company"), F.lit("workday").alias("ats"), "slug")
    stats = marked.agg(F.count_if(is_workday).alias("workday_before"), F.count_distinct("_new").alias("workday_after"), F.count_if(is_workday & F.col("_new").isNull()).alias("dropped_unsalvageable"), F.count_if(~is_workday).alias("non_workday"))
    return rows.where(~is_workday).select("company", "ats", "slug").unionByName(once), stats


def priority(registry: DataFrame, names: list[str]) -> DataFrame:
    """Targets of the companies on a list, whatever the case of their names."""
    return registry.where(F.lower("company").isin([n.lower() for n in names]))
