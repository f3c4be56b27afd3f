"""Row counts and bounds of Parquet tables from their footers: no data page is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reader that answers counts, least and most values from footers, and its switch.
_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_bounds(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row: n, and least_x and most_x of each numeric, date or boolean column, as the footers of all files state them.

    Planned for the reader that pushes aggregates into the scan, whatever the session's own is; the session's settings
    come back at once, as the plan is made here.
    """
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("most", F.max))]
        out = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), *bounds)
        out._jdf.queryExecution().executedPlan()
        return out
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
