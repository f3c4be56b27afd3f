"""Vector code compression: product quantisation by member-resident Lloyd rounds over integer vectors.

Vectors are cut into equal parts. A part lives in the bucket of (position, entry, salt) of the entry it belongs to: the
tasks of these buckets own the members, and sum them where they lie. A round rewrites members in place with the entry
that is nearest now; only parts whose entry changed go through a shuffle, to the bucket of their new entry, as a table
of arrivals in the same layout. Salts are as many as shuffle partitions, so an entry that holds most parts (a hot
vector) is dealt over all tasks. Rounds are bucketed tables in the shared folder: a lost executor costs a task, not a
round. Only codebooks pass through the driver: 4 x 256 entries of a part's length, whatever the rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import columns, materialise, scratch_path
from spindrift.scratch import discard

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers are held to this size, so that squared distances and sums stay exact in 64 bits.
LARGEST = 1 << 25
OWNER = ["position", "entry", "salt"]


def _usable(vectors: pa.Array) -> np.ndarray:
    """Which lists are neither null nor hold a null or non-finite component."""
    flat = vectors.flatten()
    bad = pc.invert(pc.fill_null(pc.is_finite(flat.cast(pa.float64())), False))
    bad_rows = pc.filter(pc.list_parent_indices(vectors), bad).to_numpy(zero_copy_only=False)
    keep = ~vectors.is_null().to_numpy(zero_copy_only=False)
    keep[bad_rows] = False
    return keep


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label and v, the floors of SCALE times the components, of the rows that can be used."""
    for batch in batches:
        batch = batch.filter(pa.array(_usable(batch["vector"])))
        vectors = batch["vector"]
        whole = np.floor(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE)
        values = pa.array(np.clip(whole, -LARGEST, LARGEST).astype(np.int32))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.ListArray.from_arrays(pa.array(ends), values)], names=["vec_id", "label", "v"])


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """(rows vec_id, label, spread, v; length of a part), written once; v is padded with zeros to PARTS equal parts of the longest vector."""
    read = columns(vectors, vec_id=vec_id, label=label, vector=vector)
    schema = T.StructType([read.schema["vec_id"], read.schema["label"], T.StructField("v", T.ArrayType(T.IntegerType()))])
    whole = read.mapInArrow(_integers, schema).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    rows = materialise(whole, "integer-vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS)
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), PARTS * width - F.size("v")))), width


def first_codebooks(rows: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """(PARTS, entries, width): the parts of the rows with the smallest vec_ids; fewer rows make fewer entries."""
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return np.array([r.v for r in seeds], np.int64).reshape(len(seeds), PARTS, width).transpose(1, 0, 2)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries) of integer parts to a codebook."""
    top = int(max(np.abs(parts).max(initial=1), np.abs(book).max(initial=1)))
    kind = np.float64 if 4 * top * top * max(1, parts.shape[1]) < 1 << 53 else np.int64  # either holds every sum exactly
    x, c = parts.astype(kind), book.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part; of equal distances the lower index."""
    found = [(d.argmin(axis=1), d.min(axis=1)) for at in range(0, len(parts), 4096) for d in [distances(parts[at : at + 4096], book)]]
    return (np.concatenate([a for a, _ in found]), np.concatenate([d for _, d in found])) if found else (np.zeros(0, np.int64),) * 2


def _next_entry(position: Column, part: Column, books: np.ndarray) -> Column:
    @F.arrow_udf("int")
    def entry(positions: pa.Array, parts: pa.Array) -> pa.Array:
        at, out = positions.to_numpy(), np.zeros(len(positions), np.int32)
        values = parts.flatten().to_numpy(zero_copy_only=False).reshape(len(at), books.shape[2])
        for p in range(PARTS):
            out[at == p] = nearest(values[at == p], books[p])[0]
        return pa.array(out)

    return entry(position, part)


class _Members:
    """Bucketed tables of parts by owner in the shared folder; names are of this run alone and go when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets, self.tables = spark, int(spark.conf.get("spark.sql.shuffle.partitions")), {}

    def write(self, parts: DataFrame, name: str) -> DataFrame:
        table, path = f"{name}_{uuid.uuid4().hex}", scratch_path(self.spark, name)
        parts.write.bucketBy(self.buckets, *OWNER).option("path", path).saveAsTable(table)
        self.tables[table] = path
        return self.spark.table(table)

    def drop(self, keep: int = 0) -> None:
        for table in list(self.tables)[: len(self.tables) - keep]:
            self.spark.sql(f"DROP TABLE {table}")
            discard(self.spark, self.tables.pop(table))

    def migrate(self, parts: DataFrame) -> DataFrame:
        """Parts with next shuffled to the owners of their next entry, and written there."""
        moved = parts.select("position", F.col("next").alias("entry"), "salt", "part")
        return self.write(moved.repartition(self.buckets, *OWNER), "arrivals")


def owner_sums(members: DataFrame, width: int) -> DataFrame:
    """(position, entry, n, sums): owners sum their own members first, then the salts of an entry meet as a row each."""
    sums = [F.sum(F.get("part", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(width)]
    owned = members.groupBy(*OWNER).agg(F.count(F.lit(1)).alias("n"), *sums)
    total = owned.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    return total.select("position", "entry", "n", F.array(*[f"s{i}" for i in range(width)]).alias("sums"))


def fit_codebooks(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (PARTS, entries, width) after the given rounds, from the rows of integer_vectors."""
    books = first_codebooks(rows, width, entries)
    if not books.shape[1]:
        return books
    store = _Members(rows.sparkSession)
    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.slice("v", p * width + 1, F.lit(width)))
    parts = rows.select(F.pmod("spread", F.lit(store.buckets)).cast("int").alias("salt"), F.posexplode(cut).alias("position", "part"))
    try:
        members = None
        for _ in range(rounds):
            judged = (parts if members is None else members).withColumn("next", _next_entry(F.col("position"), F.col("part"), books))
            if members is None:
                members = store.migrate(judged)
            else:
                judged = store.write(judged, "members")
                resident = judged.where(F.col("next") == F.col("entry")).select(*OWNER, "part")
                members = resident.unionByName(store.migrate(judged.where(F.col("next") != F.col("entry"))))
            books = books.copy()
            for r in owner_sums(members, width).toLocalIterator():
                books[r.position, r.entry] = np.array(r.sums, np.int64) // r.n
            store.drop(keep=2)
        return books
    finally:
        store.drop()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, spread, code (two hex digits a part) and error (squared distances summed), one row for each of rows."""
    width = books.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, PARTS, width)
            found = [nearest(values[:, p], books[p]) for p in range(PARTS)]
            codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["spread"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "spread", "code", "error"])

    schema = T.StructType([rows.schema[c] for c in ("vec_id", "label", "spread")] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.select("vec_id", "label", "spread", "v").mapInArrow(coded, schema)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error; the codebooks), one row for each vector that can be used.

    Vectors that are null or hold null or non-finite components are left out. Components become integers floor(1024 x),
    held to 2**25 either way. A vector shorter than the longest counts as padded with zeros, so do lengths that 4
    doesn't divide; empty vectors alone have codes of zeros. Repeated rows are members each; of equal vec_ids the
    smaller vector comes first among the first entries, null ids last. label_error sums error over equal labels, nulls
    together; a label's rows are dealt over salts. An empty table gives no rows; further columns are ignored.
    """
    rows, width = integer_vectors(vectors, vec_id, vector, label)
    books = fit_codebooks(rows, width)
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = materialise(encode(rows, books).withColumn("salt", F.pmod("spread", F.lit(salts)).cast("int")).drop("spread"), "codes")
    held = coded.groupBy("label", "salt").agg(F.sum("error").alias("e")).groupBy("label").agg(F.sum("e").alias("label_error"), F.collect_list("salt").alias("salts"))
    held = held.select(F.col("label").alias("_label"), F.explode("salts").alias("_salt"), "label_error")
    out = coded.join(held, F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt")))
    return out.select("vec_id", "label", "code", "error", "label_error"), books
