"""Vectors of postings: rows that lack one are embedded, and an inverted-file index answers top-k searches exactly.

Vectors lie in folders of cells, each around a centroid; the centroids are fitted on a bounded sample, every vector is
placed. A cell's radius, the widest angle of a member to its centroid, bounds how similar anything in it can be to a
query: a search reads the nearest cells, and then only those whose bound reaches the k-th similarity found. So fewer
probes cost reads, never results.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.scratch import exists, materialise

#: Vectors that centroids are fitted on, at most, and rounds of fitting.
SAMPLE, FIT_ROUNDS = 20_000, 8
#: Vectors of a cell, and queries, that one task multiplies at a time.
BLOCK = 4096
#: Similarities are compared after rounding to so many places, as sums in another order differ in the last bits.
PLACES = 9

Model = Callable[[list[str]], np.ndarray]
_loaded: dict[str, Model] = {}


def embed_missing(rows: DataFrame, vectors: DataFrame, ident: str, text: str, newest: str, load: Callable[[], Model], name: str, most: int | None = 10_000) -> DataFrame:
    """(ident, vector) of rows that vectors lacks, the newest first if there are more than most; null texts are empty.

    load runs once in a worker, for models that are slow to read; name tells models apart.
    """
    missing = rows.select(ident, F.coalesce(text, F.lit("")).alias("_text"), F.col(newest).alias("_newest")).join(vectors.select(ident), ident, "left_anti")
    if most is not None:
        missing = missing.orderBy(F.col("_newest").desc_nulls_last(), ident).limit(most)

    def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if name not in _loaded:
                _loaded[name] = load()
            found = np.asarray(_loaded[name](batch["_text"].to_pylist()), np.float32).reshape(batch.num_rows, -1)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * found.shape[1])
            yield pa.RecordBatch.from_arrays([batch[ident], pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=[ident, "vector"])

    return missing.select(ident, "_text").mapInArrow(embedded, T.StructType([rows.schema[ident], T.StructField("vector", T.ArrayType(T.FloatType()))]))


def _unit(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are directions of dims finite components, and those as unit vectors in double precision."""
    good = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False)
    flat = vectors.filter(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(all="ignore"):
        norms = np.sqrt((flat * flat).sum(axis=1))
        fine = np.isfinite(norms) & (norms > 0)
        good[np.flatnonzero(good)[~fine]] = False
        return good, flat[fine] / norms[fine, None]


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def fit_centroids(vectors: DataFrame, ident: str, vector: str, dims: int, cells: int) -> np.ndarray:
    """Unit centroids of a sample of at most SAMPLE vectors in order of a hash of ident, by spherical k-means."""
    some = vectors.orderBy(F.xxhash64(ident), ident).limit(SAMPLE).select(vector).toArrow()[vector].combine_chunks()
    units = _unit(some, dims)[1]
    if not len(units):
        return np.zeros((1, dims))
    rng = np.random.default_rng(7)
    centroids = units[rng.choice(len(units), min(cells, len(units)), replace=False)]
    for _ in range(FIT_ROUNDS):
        near = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """Centroids, and of each cell its widest angle and how many vectors it has; writes counts the batches added."""

    path: str
    centroids: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    writes: int = 0

    @staticmethod
    def build(vectors: DataFrame, ident: str, vector: str, dims: int, path: str, cells: int = 64) -> VectorIndex:
        """Vectors that are null, zero, of other lengths or hold null or non-finite components are left out."""
        centroids = fit_centroids(vectors, ident, vector, dims, cells)
        empty = np.zeros(len(centroids))
        return VectorIndex(path, centroids, empty, empty.astype(np.int64)).add(vectors, ident, vector)

    def add(self, vectors: DataFrame, ident: str, vector: str) -> VectorIndex:
        """The index with further vectors, placed around the same centroids."""
        centroids, dims = self.centroids, self.centroids.shape[1]

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, units = _unit(batch["vector"], dims)
                near = units @ centroids.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(units)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(good)), _lists(units), pa.array(angle), pa.array(cell.astype(np.int32))], names=["id", "unit", "angle", "cell"])

        read = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("vector"))
        schema = T.StructType([read.schema["id"], T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        read.mapInArrow(placed, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.path}/write={self.writes}")
        radii, counts = self.radii.copy(), self.counts.copy()
        if exists(vectors.sparkSession, f"{self.path}/write={self.writes}/_SUCCESS"):
            found = vectors.sparkSession.read.schema(schema).parquet(f"{self.path}/write={self.writes}")
            for r in found.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
                radii[r.cell], counts[r.cell] = max(radii[r.cell], r.angle), counts[r.cell] + r.n
        return VectorIndex(self.path, centroids, radii, counts, self.writes + 1)

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """(queries, cells): no member of a cell is more similar; minus one and less for empty cells."""
        apart = np.arccos(np.clip(units @ self.centroids.T, -1, 1))
        return np.where(self.counts > 0, np.cos(np.maximum(0, apart - self.radii)) + 1e-7, -2.0)

    def members(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        """(id, unit, cell) of the given cells, whose folders alone are listed and read, or of all."""
        wanted = range(len(self.centroids)) if cells is None else cells
        paths = [p for w in range(self.writes) for c in wanted if self.counts[c] and exists(spark, p := f"{self.path}/write={w}/cell={c}")]
        kind = spark.read.parquet(f"{self.path}/write=0").schema["id"].dataType.simpleString() if paths else "long"
        schema = f"id {kind}, unit array<double>, write int, cell int"
        if not paths:
            return spark.createDataFrame([], schema).drop("write")
        return spark.read.schema(schema).option("basePath", self.path).parquet(*paths).drop("write")

    def top(self, spark: SparkSession, query: list[float], k: int, probes: int = 2) -> list[tuple]:
        """(id, similarity) of the k vectors nearest to one query, exactly: the nearest cells first, then those that could still hold one."""
        good, units = _unit(pa.array([query], pa.list_(pa.float64())), self.centroids.shape[1])
        if not good.any():
            return []
        bounds, found, seen, least = self.bounds(units)[0], [], set(), -2.0
        order = [int(c) for c in np.argsort(-bounds) if bounds[c] > -2]
        some = order[:probes]
        while some:
            seen.update(some)
            best = similar_rows(self.members(spark, some), units[0], k)
            found = sorted([*found, *[(r.id, r.similarity) for r in best.collect()]], key=lambda x: (-x[1], x[0]))[:k]
            least = found[-1][1] if len(found) == k else -2.0
            some = [c for c in order if c not in seen and bounds[c] >= least]
        return found


def similar_rows(members: DataFrame, unit: np.ndarray, k: int) -> DataFrame:
    """The k members most similar to one unit vector."""

    @F.arrow_udf("double")
    def likeness(units: pa.Array) -> pa.Array:
        return pa.array(np.round(units.flatten().to_numpy(zero_copy_only=False).reshape(len(units), len(unit)) @ unit, PLACES))

    return members.select("id", likeness("unit").alias("similarity")).orderBy(F.col("similarity").desc(), "id").limit(k)


def search_many(queries: DataFrame, index: VectorIndex, ident: str, vector: str, k: int, probes: int = 2, cells: bool = False) -> DataFrame:
    """(query, id, similarity) of the k nearest vectors of every query, itself left out, exactly.

    Two rounds: each query against its nearest cells, then against those whose bound reaches its k-th similarity so
    far. Cells are multiplied in blocks of members and queries, a block a task at a time, and each block sends on k rows a
    query. With cells the number of cells that each query read comes too. Ids of queries are unique; a query without a
    direction (null, zero, other lengths, non-finite) finds nothing.
    """
    dims, spark = index.centroids.shape[1], queries.sparkSession
    read = queries.select(F.col(ident).alias("query"), F.col(vector).alias("vector"))
    unit_type, cell_type = T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and cell it has to look at: the nearest ones if least is null, else those that reach it and were no first probes."""
        for batch in batches:
            good, units = _unit(batch["vector"], dims)
            batch = batch.filter(pa.array(good))
            bounds = index.bounds(units)
            rank = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1, kind="stable")
            first = rank < probes
            if "least" in batch.schema.names:
                least = pc.fill_null(batch["least"], -2.0).to_numpy(zero_copy_only=False)
                wanted = ~first & (bounds >= least[:, None])
            else:
                wanted = first
            row, cell = np.nonzero(wanted & (bounds > -2))
            yield pa.RecordBatch.from_arrays([batch["query"].take(pa.array(row)), _lists(units[row]) if len(row) else pa.array([], pa.list_(pa.float64())), pa.array(cell.astype(np.int32))], names=["query", "unit", "cell"])

    def multiplied(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "id": [], "similarity": []}
        if left.num_rows and right.num_rows:
            own = left["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            asked = right["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ids, names = left["id"].combine_chunks(), right["query"].combine_chunks()
            order = pc.sort_indices(ids).to_numpy()
            ids, own = ids.take(pa.array(order)), own[order]
            for at, name in enumerate(names.to_pylist()):
                likeness = np.round(own @ asked[at], PLACES)
                likeness[pc.fill_null(pc.equal(ids, pa.scalar(name, ids.type)), False).to_numpy(zero_copy_only=False)] = -np.inf
                best = np.argsort(-likeness, kind="stable")[:k]
                best = best[likeness[best] > -np.inf]
                out["query"] += [name] * len(best)
                out["id"] += ids.take(pa.array(best)).to_pylist()
                out["similarity"] += likeness[best].tolist()
        return pa.table({"query": pa.array(out["query"], right.schema.field("query").type), "id": pa.array(out["id"], left.schema.field("id").type), "similarity": pa.array(out["similarity"], pa.float64())})

    members = index.members(spark)
    pair_schema = T.StructType([read.schema["query"], unit_type, cell_type])
    made = T.StructType([read.schema["query"], members.schema["id"], T.StructField("similarity", T.DoubleType())])
    best = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    blocks = {c: max(1, -(-int(n) // BLOCK)) for c, n in enumerate(index.counts)}
    n_blocks = F.get(F.lit([blocks[c] for c in range(len(blocks))]), F.col("cell"))

    def looked(pairs: DataFrame) -> DataFrame:
        asked = {r.cell: max(1, -(-r.n // BLOCK)) for r in pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
        n_asked = F.get(F.lit([asked.get(c, 0) for c in range(len(blocks))]), F.col("cell"))
        left = members.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(1), n_asked, F.lit(1)))) if asked else members.withColumns({"block": F.lit(0), "part": F.lit(0)}).limit(0)
        right = pairs.withColumn("part", (F.pmod(F.xxhash64("query"), n_asked) + 1).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        keys = ["cell", "block", "part"]
        return left.where(n_asked > 0).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiplied, made)

    def kept(found: DataFrame) -> DataFrame:
        return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")

    first_pairs = materialise(read.mapInArrow(paired, pair_schema), "probes")
    first = materialise(kept(looked(first_pairs)), "first-found")
    least = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least")).withColumnRenamed("query", "_query")
    rest = read.join(least, F.col("query").eqNullSafe(F.col("_query")), "left").drop("_query")
    rest_pairs = materialise(rest.mapInArrow(paired, pair_schema), "probes")
    out = kept(first.unionByName(looked(rest_pairs)))
    if cells:
        spent = first_pairs.unionByName(rest_pairs).groupBy(F.col("query").alias("_query")).agg(F.count(F.lit(1)).alias("cells"))
        out = out.join(spent, F.col("query").eqNullSafe(F.col("_query"))).drop("_query")
    return out


def describe(index: VectorIndex) -> str:
    """What a search needs besides the folder, as text to keep beside it."""
    return json.dumps({"path": index.path, "writes": index.writes, "centroids": index.centroids.tolist(), "radii": index.radii.tolist(), "counts": index.counts.tolist()})


def reopen(text: str) -> VectorIndex:
    held = json.loads(text)
    return VectorIndex(held["path"], np.array(held["centroids"]), np.array(held["radii"]), np.array(held["counts"], np.int64), held["writes"])
