"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash rotates a vector by three rounds of random signs and a Walsh-Hadamard transform and takes the nearest signed
axis; a table joins a few such hashes, so that buckets stay small at any number of vectors. A vector enters its own
bucket and the next most likely ones of each table. Buckets are cut into blocks and compared in pairs of blocks by
matrix products, in double precision: pairs are counted where they first meet and never emitted; what leaves a task
is a count for each vector and links that join its members. Identical vectors are one content throughout, named by its
digest, and travel in single precision where that loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import columns, materialise
from spindrift.operators.components import components

COSINE = 0.9
#: Vectors a bucket should hold on average; sets how many hashes a table joins.
BUCKET = 512
#: Tables where each is one hash, doubled with every hash joined to it, and buckets a vector enters in each. Recall is measured in the tests.
TABLES, PROBES = 8, 2
#: Members of a block; two blocks are compared in one task.
BLOCK = 1024
#: Least length of a rotated vector: in fewer dimensions rounds of signs only turn by a few fixed angles, so shorter vectors are padded.
LEAST_DIM = 16


@lru_cache(maxsize=64)
def _signs(dim: int, table: int, hashes: int) -> np.ndarray:
    """Random signs of each hash's three rounds: (hashes, 3, dim)."""
    return np.random.default_rng([dim, table, hashes]).choice(np.array([-1.0, 1.0], np.float32), (hashes, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, dim = x.shape
    half = 1
    while half < dim:
        x = x.reshape(n, dim // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, dim)
        half *= 2
    return x


def tables_of(hashes: int) -> int:
    return TABLES << (hashes - 1)


def rotated_length(dim: int) -> int:
    return max(LEAST_DIM, 1 << (dim - 1).bit_length())


def buckets(vectors: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """The probes buckets of each unit vector in each table, likeliest first: (vectors, tables, probes)."""
    n, dim = vectors.shape
    padded = rotated_length(dim)
    x = np.zeros((n, padded), np.float32)
    x[:, :dim] = vectors
    out = np.zeros((n, tables, probes), np.int64)
    near = min(2 * padded, probes)
    for t in range(tables):
        axes, losses = [], []
        for signs in _signs(padded, t, hashes):
            y = x
            for s in signs:
                y = hadamard(y * s)
            both = np.concatenate([y, -y], axis=1)
            top = np.argpartition(-both, near - 1, axis=1)[:, :near] if near < 2 * padded else np.argsort(-both, axis=1)
            value = np.take_along_axis(both, top, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            value, top = np.take_along_axis(value, order, axis=1), np.take_along_axis(top, order, axis=1)
            axes.append(top)
            losses.append((value[:, :1] - value) ** 2)
        choices = sorted(product(range(near), repeat=hashes), key=sum)
        loss = np.stack([sum(losses[h][:, c] for h, c in enumerate(choice)) for choice in choices], axis=1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        code = np.zeros((n, best.shape[1]), np.int64)
        for h in range(hashes):
            pick = np.array([choice[h] for choice in choices])[best]
            code = code * (2 * padded) + np.take_along_axis(axes[h], pick, axis=1)
        out[:, t, : code.shape[1]] = code
        out[:, t, code.shape[1] :] = code[:, -1:]
    return out


_PLACED = pa.schema([("content", pa.binary()), ("copies", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary()), ("codes", pa.binary()), ("places", pa.list_(pa.int64()))])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and the vector's doubles, or null where it can link with nothing."""
    for batch in batches:
        rows = []
        for x in batch["embedding"].to_pylist():
            v = None if x is None or any(c is None for c in x) else np.array(x, np.float64)
            rows.append(v.tobytes() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(rows, pa.binary())], names=["vec_id", "vector"])


def _narrow(v: np.ndarray) -> bytes:
    single = v.astype(np.float32)
    return single.tobytes() if (single == v).all() else v.tobytes()


def _units(vectors: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision from packed ones."""
    x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in vectors]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _code_type(dim: int, hashes: int) -> str:
    return "<i4" if (2 * rotated_length(dim)) ** hashes < 1 << 31 else "<i8"


def _place(tables: int, hashes: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(v, np.float64) for v in batch["vector"].to_pylist()]
            vectors, codes, places = [_narrow(v) for v in raw], [None] * len(raw), [None] * len(raw)
            for dim in {len(v) for v in raw}:
                at = [i for i, v in enumerate(raw) if len(v) == dim]
                found = buckets(_units([vectors[i] for i in at], dim), tables, hashes, probes)
                for i, p in zip(at, found, strict=True):
                    places[i], codes[i] = p.ravel(), p.astype(_code_type(dim, hashes)).tobytes()
            dims = pa.array([len(v) for v in raw], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["content"], batch["copies"], dims, pa.array(vectors, pa.binary()), pa.array(codes, pa.binary()), pa.array(places, pa.list_(pa.int64()))], schema=_PLACED)

    return run


def _components(mask: np.ndarray) -> np.ndarray:
    """The least member each member of a symmetric link matrix can reach."""
    label = np.arange(len(mask))
    while True:
        low = np.minimum(label, np.where(mask, label[None, :], len(mask)).min(axis=1, initial=len(mask)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


_FOUND = pa.schema([("content", pa.binary()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _compare(tables: int, hashes: int, probes: int):
    def solve(rows: list[tuple], table: int, bucket: int, dim: int) -> Iterator[tuple[bytes, int, bytes, bytes]]:
        ids, copies = [r[0] for r in rows], np.array([r[1] for r in rows])
        units = _units([r[2] for r in rows], dim)
        places = np.stack([np.frombuffer(r[3], _code_type(dim, hashes)) for r in rows]).reshape(len(rows), tables, probes)
        block = np.array([r[4] for r in rows])
        linked = units @ units.T >= COSINE
        np.fill_diagonal(linked, False)
        if len(set(block.tolist())) > 1:
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(linked, 1))
        for t in range(table + 1):
            if not len(a):
                return
            met = np.zeros(len(a), bool)
            for p in range(probes):
                for q in range(probes):
                    same = places[a, t, p] == places[b, t, q]
                    met |= same & (places[a, t, p] < bucket) if t == table else same
            a, b = a[~met], b[~met]
        if not len(a):
            return
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        mask = np.zeros((len(ids), len(ids)), bool)
        mask[a, b] = mask[b, a] = True
        for i, low in enumerate(_components(mask).tolist()):
            if links[i]:
                yield ids[i], int(links[i]), ids[i], ids[low]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def packed(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            for table, bucket, dim, first, second, content, copies, vector, codes, block in zip(*batch.to_pydict().values(), strict=True):
                if (table, bucket, dim, first, second) != key:
                    if len(rows) > 1:
                        out += solve(rows, *key[:3])
                    key, rows = (table, bucket, dim, first, second), []
                rows.append((content, copies, vector, codes, block))
            if len(out) > 10_000:
                yield packed(out)
                out = []
        if len(rows) > 1:
            out += solve(rows, *key[:3])
        if out:
            yield packed(out)

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row a row.

    Links are pairs with a cosine of 0.9 or more that share a bucket. Null, empty and zero vectors, and those with null
    or non-finite components, link with nothing; vectors of different lengths don't either. Identical vectors are
    linked with each other. Rows that repeat a vec_id are vectors like others, each with its own links; rows with a
    null vec_id link with nothing and are kept. An empty table gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = columns(vectors, vec_id=vec_id, embedding=embedding).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    digest = F.when(F.col("vector").isNotNull(), F.substring(F.unhex(F.sha2("vector", 256)), 1, 16))
    clean = materialise(rows.mapInArrow(_clean, "vec_id long, vector binary").withColumn("content", digest), "vectors")
    distinct = clean.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull()).groupBy("content").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    reps = materialise(distinct, "distinct-vectors")
    n, dim = reps.agg(F.count(F.lit(1)), F.max(F.octet_length("vector") / 8)).first()
    hashes = max(1, math.ceil(math.log(max(1, n / bucket)) / math.log(2 * rotated_length(int(dim or 1)))))
    tables, probes = tables_of(hashes), PROBES
    placed = materialise(reps.select("content", "copies", "vector").mapInArrow(_place(tables, hashes, probes), "content binary, copies long, dim int, vector binary, codes binary, places array<long>"), "places")
    spots = placed.select("content", "dim", F.posexplode("places").alias("at", "bucket")).select("content", "dim", F.expr(f"at div {probes}").cast("int").alias("table"), "bucket").distinct()
    full = spots.groupBy("table", "bucket", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("table", "bucket", "dim", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # A member's block within a bucket is a hash, so no bucket has to be numbered in one task.
    member = spots.join(full, ["table", "bucket", "dim"]).withColumn("block", F.pmod(F.xxhash64("content", "table"), F.col("blocks")).cast("int"))
    groups, held = ["table", "bucket", "dim", "first", "second"], ["content", "copies", "vector", "codes"]
    pairs = member.join(placed.select(*held), "content").select("table", "bucket", "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block", *held)
    pairs = pairs.select("table", "bucket", "dim", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), *held, "block")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(pairs.repartition(parts, *groups).sortWithinPartitions(*groups).mapInArrow(_compare(tables, hashes, probes), "content binary, n long, a binary, b binary"), "found")
    counts = found.groupBy("content").agg(F.sum("n").alias("n"))
    linked = materialise(components(found.select("a", "b")).join(reps.select(F.col("content").alias("vertex"), "least"), "vertex"), "linked")
    classes = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(F.col("vertex").alias("content"), "component_id")
    of_content = (
        reps.select("content", "least", "copies")
        .join(counts, "content", "left")
        .join(classes, "content", "left")
        .select("content", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    joined = clean.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("content")).alias("content")).join(of_content, "content", "left")
    joined = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
