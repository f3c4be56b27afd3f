"""Which targets come next: orders, caps, shards, claims, streaks and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.scratch import materialise


def claim_order(now: Column, aging_days: float = 14, *, due: str = "next_due_at", tier: str = "tier", scores: list[str] | None = None, last: str = "slug") -> list[Column]:
    """Targets overdue for longer than aging_days first, then by tier, scores and due time; last breaks ties."""
    aged = F.coalesce(F.col(due) <= now - F.make_dt_interval(secs=F.lit(aging_days * 86_400)), F.lit(False))
    rank = F.when(F.col(tier) == "P0", 0).when(F.col(tier) == "P1", 1).when(F.col(tier) == "P2", 2).otherwise(3)
    by_score = [F.coalesce(s, F.lit(0)).desc() for s in scores or ["scrape_score", "priority_score", "fresh_job_rate"]]
    return [F.when(aged, 0).otherwise(1), rank, *by_score, F.col(due).asc_nulls_first(), F.col(last)]


def claim(targets: DataFrame, owner: str, now: Column, minutes: int, limit: int) -> DataFrame:
    """Targets with a lease on the first limit rows that are due, alive and free; claimed is set on those."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") < now)
    due = ~F.coalesce(F.col("is_dead").cast("boolean"), F.lit(False)) & free & (F.col("next_due_at").isNull() | (F.col("next_due_at") <= now))
    picked = targets.where(due).orderBy(*claim_order(now)).limit(limit).select("ats_type", "slug").withColumn("claimed", F.lit(True))
    out = targets.join(picked, ["ats_type", "slug"], "left")
    until = now + F.make_dt_interval(mins=F.lit(minutes))
    return out.withColumn("lease_owner", F.when(F.col("claimed"), F.lit(owner)).otherwise(F.col("lease_owner"))).withColumn("lease_until", F.when(F.col("claimed"), until).otherwise(F.col("lease_until"))).withColumn("claimed", F.coalesce("claimed", F.lit(False)))


def release(targets: DataFrame, owner: str) -> DataFrame:
    mine = F.col("lease_owner") == owner
    return targets.withColumn("lease_until", F.when(mine, F.lit(None)).otherwise(F.col("lease_until"))).withColumn("lease_owner", F.when(mine, F.lit(None)).otherwise(F.col("lease_owner")))


def budget_cap(df: DataFrame, group: str, order: list[Column], caps: DataFrame) -> DataFrame:
    """The first cap rows of each group; caps has (group, budget, workers, estimate) and allows budget * workers / estimate, floored."""
    caps = caps.select(group, F.floor(F.col("budget") * F.col("workers") / F.col("estimate")).alias("_cap"))
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.join(caps, group, "left").where(F.col("_cap").isNull() | (F.col("_n") <= F.col("_cap"))).drop("_n", "_cap")


def shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    """shard 0.. of contiguous slices of the sorted keys, the first ones a row longer where they don't divide.

    Ranks come from range partitions and their totals, so no task holds all rows as a global window would.
    """
    size = F.expr(f"_total div {shards}")
    r, cut = F.col("_rank") - 1, (F.col("_total") % shards) * (size + 1)
    slot = F.when(r < cut, F.floor(r / (size + 1))).otherwise(F.col("_total") % shards + F.floor((r - cut) / F.greatest(size, F.lit(1))))
    return _ranked(df, key).withColumn("shard", slot.cast("int")).drop("_rank", "_total")


def rank_all(df: DataFrame, key: str) -> DataFrame:
    """_rank 1.. in order of a unique key, over range partitions."""
    return _ranked(df, key).drop("_total")


def _ranked(df: DataFrame, key: str) -> DataFrame:
    """_rank and _total: rows are sorted into ranges once and written with their place in them, so that both uses of the ranges see the same ones."""
    placed = materialise(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at") - F.shiftleft("_part", 33) + 1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = counts.select("_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_total"))
    return placed.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_in") + F.col("_before")).drop("_at", "_part", "_in", "_before")


def trailing_streak(df: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """(key, streak): how many of a key's last rows in a row are bad. Two aggregates, no window: those after the last good row.

    order must be unique within a key.
    """
    at = F.struct(*order)
    last_good = df.groupBy(F.col(key).alias("_k")).agg(F.max(F.when(~bad, at)).alias("_good"))
    joined = df.select(F.col(key), at.alias("_at"), bad.alias("_bad")).join(last_good, F.col(key) == F.col("_k"))
    after = F.col("_bad") & (F.col("_good").isNull() | (F.col("_at") > F.col("_good")))
    return joined.groupBy(key).agg(F.count_if(after).alias("streak"))


def error_window(df: DataFrame, key: str, order: list[str], bad: Column, size: int = 50, least: int = 20, most: float = 0.3) -> DataFrame:
    """samples, error_rate and tripped over a key's last size rows, at each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(size - 1), 0)
    out = df.withColumn("samples", F.count(F.lit(1)).over(w)).withColumn("error_rate", F.avg(bad.cast("double")).over(w))
    return out.withColumn("tripped", (F.col("samples") >= least) & (F.col("error_rate") >= most))


def changed(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """Whether the value differs from the key's previous row; the first row counts as changed."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("changed", ~value.eqNullSafe(before))
