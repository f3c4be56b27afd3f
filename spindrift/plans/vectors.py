"""Searches of an inverted-file index over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.vectorindex import VectorIndex, search_many
from spindrift.plans.catalog import QUERIES, SQL, table
from spindrift.scratch import scratch_path


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100, itself left out; the index over all is written first."""
    rows = table(spark, sf_dir, "embeddings")
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    index = VectorIndex.build(rows, "vec_id", "embedding", dims, scratch_path(spark, "vector-index"))
    found = search_many(rows.where(F.col("vec_id") % 100 == 0), index, "vec_id", "embedding", 10)
    return found.select(F.col("query").alias("vec_id"), F.col("id").alias("other_id"), F.round("similarity", 6).alias("similarity"))


QUERIES["vector_index_topk"] = vector_index_topk
SQL["vector_index_topk"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id, o.vec_id AS other_id, round(list_dot_product(q.e, o.e) / (q.n * o.n), 9) AS s FROM v q JOIN v o ON q.vec_id % 100 = 0 AND q.vec_id <> o.vec_id)
SELECT vec_id, other_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other_id) AS r FROM s) WHERE r <= 10
"""
