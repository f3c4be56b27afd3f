"""Connected components of a link table, without collecting anything: alternating large-star and small-star steps.

Each step joins every link with the least neighbour of one end. A hub, a vertex with links from a third of all others,
is dealt over tasks: neighbours are reduced by (vertex, salt) first, and a vertex's least neighbour goes only to the
salts that hold a link of it, so the spread rows never outnumber the links. Rounds are written to the shared folder,
which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.scratch import materialise

#: More rounds than any graph needs in practice (they grow with the logarithm of its size); reaching it is an error.
MAX_ROUNDS = 60
#: Parts a vertex's links are dealt into.
SALTS = 64


def _salted(links: DataFrame) -> DataFrame:
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))


def _least(salted: DataFrame) -> DataFrame:
    """(u, m, salts): the least neighbour of each vertex and the salts of its links."""
    return salted.groupBy("u", "salt").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))


def _large_star(links: DataFrame) -> DataFrame:
    both = _salted(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = _least(both).select("u", F.least("u", "m").alias("m"), F.explode("salts").alias("salt"))
    return both.where("v > u").join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    salted = _salted(links)
    least = _least(salted)
    tied = salted.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex with a link to another; component is its least vertex. Nulls and loops are left out.

    Vertices may be of any type that has an order. No links give no rows.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links, before = materialise(links, "links"), None
    for _ in range(MAX_ROUNDS):
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            return links.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
        before = state
        links = materialise(_small_star(_large_star(links).distinct()).distinct(), "links")
    raise RuntimeError("components did not settle")
