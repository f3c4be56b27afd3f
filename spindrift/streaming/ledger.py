"""A sink that posts each row once: batches land in folders of their own, a ledger remembers what was posted, a commit makes both count.

A batch is written in three steps: its rows and their hashes in folders named after the batch, then a commit file. A
crash before the commit leaves folders that no reader looks at and that the batch, when it comes again, overwrites; a
crash after it makes the stream bring the batch again, which is then skipped. So no row is lost and none is posted twice,
whatever step a crash hits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.scratch import exists


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


@dataclass(frozen=True)
class Ledger:
    """Where rows, hashes and commits lie, and for how many seconds a posted hash keeps its like from being posted again."""

    path: str
    memory_s: float = 7 * 86_400

    def commits(self, spark: SparkSession) -> dict[int, float]:
        """When each committed batch was committed: a small file a batch."""
        system, where = _system(spark, f"{self.path}/commits")
        if not system.exists(where):
            return {}
        names = [s.getPath().getName() for s in system.listStatus(where)]
        return {int(n.split("-")[0]): float(n.split("-")[1]) for n in names if n[0].isdigit()}

    def _commit(self, spark: SparkSession, batch: int, at: float) -> None:
        """The name holds the time, so a commit is one create and nothing to read half."""
        system, where = _system(spark, f"{self.path}/commits/{batch}-{at:.3f}")
        system.create(where, False).close()

    def remembered(self, spark: SparkSession, now: float) -> DataFrame:
        """(hash) of rows that batches committed within memory posted; older batches' folders are not read."""
        recent = [b for b, at in self.commits(spark).items() if now - at <= self.memory_s]
        paths = [p for b in recent if exists(spark, p := f"{self.path}/ledger/batch={b}")]
        if not paths:
            return spark.createDataFrame([], "hash string")
        return spark.read.schema("hash string").parquet(*paths)

    def posted(self, spark: SparkSession, schema: str) -> DataFrame:
        """All rows of committed batches, with their batch."""
        paths = [p for b in self.commits(spark) if exists(spark, p := f"{self.path}/rows/batch={b}")]
        if not paths:
            return spark.createDataFrame([], f"{schema}, batch int")
        return spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.path}/rows").parquet(*paths)

    def sink(self, identity: Column, order: list[Column], clock: Callable[[], float], step: Callable[[str], None] = lambda name: None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: of rows with one identity the first by order is posted, unless its like was within memory. step is told each step (tests crash there)."""

        def post(rows: DataFrame, batch: int) -> None:
            spark, now = rows.sparkSession, clock()
            if batch in self.commits(spark):
                return
            hashed = rows.withColumn("hash", F.sha2(identity.cast("string"), 256)).where("hash IS NOT NULL")
            first = hashed.groupBy("hash").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
            new = first.join(self.remembered(spark, now), "hash", "left_anti").select("hash", "_row.*")
            step("begin")
            new.drop("hash").write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
            step("rows")
            # The hashes of what was written, not of a second evaluation.
            written = spark.read.schema(rows.schema).parquet(f"{self.path}/rows/batch={batch}")
            written.select(F.sha2(identity.cast("string"), 256).alias("hash")).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")
            step("ledger")
            self._commit(spark, batch, now)
            step("commit")

        return post

