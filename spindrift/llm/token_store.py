"""Content-addressed store of token ids.

Each document's ids are cut where a rolling hash over the last ids says so, so equal passages give equal chunks
wherever they stand. A chunk is stored once under its digest; a document is a recipe, the list of its digests. Recipes
lie in files in ascending order of document, and a Merkle manifest over them seals the store: a document's id, place,
lengths and chunk digests under its root, roots of up to 1024 neighbours under a node, and so on up to one root.

Layout of a store: data/kind=chunk (digest, width, ids), data/kind=recipe (as encoded), recipes (shard, place, within,
doc_id, n_tokens, digests, ends), shards (shard, base, docs_before: a row a file of recipes), manifest (level, node,
hash).
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import columns, scratch_path, slices
from spindrift.llm.word_ids import encoder

#: Ids of a chunk: at least, on average beyond that (a power of two), at most.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 64, 256, 2048
#: Ids under the rolling hash; less than MIN_CHUNK, so a window never leaves its document.
ROLL = 16
#: Digests a task remembers to emit a chunk once; starting anew only lets repeats pass, which are merged later.
SEEN_DIGESTS = 200_000
FANOUT = 1024
DATA = "kind string, key binary, width int, ids binary, doc_id long, n_tokens long, digests array<binary>, ends array<long>"
RECIPES = "shard int, place long, within long, doc_id long, n_tokens long, digests array<binary>, ends array<long>"
_DATA = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("width", pa.int32()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Store:
    path: str

    def chunks(self, spark: SparkSession) -> DataFrame:
        data = spark.read.schema("kind string, key binary, width int, ids binary").parquet(f"{self.path}/data")
        return data.where(F.col("kind") == "chunk").select(F.col("key").alias("digest"), "width", "ids")

    def recipes(self, spark: SparkSession) -> DataFrame:
        """seq, doc_id, start, n_tokens, digests, ends and root of every document."""
        shards = F.broadcast(spark.read.parquet(f"{self.path}/shards"))  # a row a shuffle partition of the writer
        rows = spark.read.schema(RECIPES).parquet(f"{self.path}/recipes").join(shards, "shard")
        rows = rows.select((F.col("docs_before") + F.col("place")).alias("seq"), "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "digests", "ends")
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "start", "n_tokens")]
        return rows.withColumn("root", F.sha2(F.concat_ws("|", *parts, F.array_join(F.col("ends").cast("array<string>"), ","), F.array_join(F.transform("digests", F.hex), ",")), 256))

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/manifest")


def cut_points(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    """Ends of the chunks of documents laid end to end; ends: the documents' ends."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        factor = np.uint64(0xD1342543DE82EF95)
        width = 1
        while width < ROLL:
            h[width:] = h[width:] + h[:-width] * factor
            factor, width = factor * factor, 2 * width
    marks = (np.flatnonzero((h >> np.uint64(40)) & np.uint64(MEAN_CHUNK - 1) == 0) + 1).tolist()
    cuts, at, i = [], 0, 0
    for end in ends.tolist():
        while at < end:
            i = bisect_left(marks, at + MIN_CHUNK, i)
            at = min(marks[i] if i < len(marks) else end, at + MAX_CHUNK, end)
            cuts.append(at)
    return cuts


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer), set()
        for batch in (part for whole in batches for part in slices(whole)):
            doc_ids = batch["doc_id"].to_pylist()
            ids, counts = enc.encode_ended(batch["text"].to_pylist(), end_id)
            ends = np.cumsum(counts, dtype=np.int64)
            narrow = bool(len(ids)) and ids.max() < 65536
            width, raw = (2, ids.astype("<u2").tobytes()) if narrow else (4, ids.tobytes())
            out, doc, at, digests, stops, begin = [], 0, 0, [], [], 0
            for cut in cut_points(ids, ends):
                payload = raw[at * width : cut * width]
                digest = hashlib.blake2b(payload, digest_size=16, salt=bytes([width])).digest()
                digests.append(digest)
                stops.append(cut - begin)
                if digest not in seen:
                    if len(seen) >= SEEN_DIGESTS:
                        seen.clear()
                    seen.add(digest)
                    out.append(("chunk", digest, width, payload, None, None, None, None))
                at = cut
                if cut == ends[doc]:
                    out.append(("recipe", hashlib.blake2b(digest + str(doc_ids[doc]).encode(), digest_size=16).digest(), None, None, doc_ids[doc], cut - begin, digests, stops))
                    doc, begin, digests, stops = doc + 1, cut, [], []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DATA, strict=True)] if out else [pa.array([], f.type) for f in _DATA], schema=_DATA)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted recipes with their file's number, their place in it and the ids before them in it."""
    shard, place, within = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n, tokens = batch.num_rows, batch["n_tokens"].to_numpy()
        before = within + np.cumsum(tokens) - tokens
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(place, place + n)), pa.array(before), *batch.columns], names=["shard", "place", "within", *batch.schema.names])
        place, within = place + n, within + int(tokens.sum())


def write_store(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> Store:
    """Encode whole texts, append end_id to each, and write a store.

    Null text counts as empty (the end id alone), a null id sorts first, rows that repeat an id stand side by side in
    the order of their ids' number and chunks, an empty table gives an empty store; further columns are ignored.
    """
    spark = docs.sparkSession
    store = Store(path or scratch_path(spark, "token-store"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = columns(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    # Of chunks of one digest, a row a task at most, the first is stored; recipes all are.
    again = F.row_number().over(Window.partitionBy("kind", "key").orderBy("width"))
    data = docs.mapInArrow(_encode(tokenizer, end_id), DATA).repartition(parts, "key").withColumn("_n", again).where((F.col("_n") == 1) | (F.col("kind") == "recipe")).drop("_n")
    data.write.partitionBy("kind").option("compression", "zstd").parquet(f"{store.path}/data")
    encoded = spark.read.schema(DATA).parquet(f"{store.path}/data").where(F.col("kind") == "recipe").select("doc_id", "n_tokens", "digests", "ends")
    numbered = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "digests").mapInArrow(_numbered, RECIPES)
    numbered.write.option("compression", "zstd").parquet(f"{store.path}/recipes")
    shards = spark.read.schema(RECIPES).parquet(f"{store.path}/recipes").groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    shards.select("shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("docs_before")).write.parquet(f"{store.path}/shards")
    _merkle(store.recipes(spark)).write.parquet(f"{store.path}/manifest")
    return store


def _merkle(recipes: DataFrame) -> DataFrame:
    """(level, node, hash): each node hashes up to FANOUT nodes below it, in order; the highest level has one."""
    level = recipes.select(F.col("seq").alias("node"), F.col("root").alias("hash"))
    n, depth, levels = recipes.count(), 0, []
    while n > 1 or depth == 0:
        depth, n = depth + 1, -(-n // FANOUT)
        level = (
            level.groupBy(F.expr(f"node div {FANOUT}").alias("node"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), "hash"))).alias("below"))
            .select("node", F.sha2(F.array_join(F.col("below.hash"), ""), 256).alias("hash"))
        )
        levels.append(level.withColumn("level", F.lit(depth)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("level", "node", "hash")


def _zero_bytes() -> np.ndarray:
    """tables[k][i][b]: what appending 2**k zero bytes does to a CRC whose byte i is b and others 0."""

    def times(matrix: list[int], vector: int) -> int:
        total = 0
        for row in matrix:
            total ^= row * (vector & 1)
            vector >>= 1
        return total

    bit = [0xEDB88320] + [1 << i for i in range(31)]
    matrix, tables = bit, []
    for _ in range(3):
        matrix = [times(matrix, row) for row in matrix]
    for _ in range(44):
        tables.append([[times(matrix, b << 8 * i) for b in range(256)] for i in range(4)])
        matrix = [times(matrix, row) for row in matrix]
    return np.array(tables, np.uint32)


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    return _zero_bytes()


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 parts moved before n_bytes further bytes: the parts of a whole, so moved, XOR to its CRC-32."""
    crc, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k, table in enumerate(_tables()):
        if not (n_bytes >> k).any():
            break
        moved = table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]
        crc = np.where(n_bytes >> k & 1, moved, crc)
    return crc


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every stored chunk hashed again: its digest, ids and CRC-32."""
    for batch in batches:
        out = []
        for digest, width, payload in (row for part in slices(batch, "ids") for row in zip(*part.to_pydict().values(), strict=True)):
            if hashlib.blake2b(payload, digest_size=16, salt=bytes([width])).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            out.append((digest, len(payload) // width, zlib.crc32(np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes())))
        yield pa.RecordBatch.from_pydict(dict(zip(("digest", "n", "crc"), zip(*out, strict=True), strict=True)) if out else {"digest": [], "n": [], "crc": []}, schema=_CHECKED)


_CHECKED = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])


def _placed(store: Store, spark: SparkSession) -> DataFrame:
    """A row for each chunk of each recipe: seq, doc_id, start, n_tokens, n_chunks, pos, digest, size (its ids), after (ids behind it)."""
    recipes = store.recipes(spark).withColumn("n_chunks", F.size("digests"))
    sizes = F.transform("ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(0))
    exploded = recipes.select("seq", "doc_id", "start", "n_tokens", "n_chunks", F.posexplode(F.arrays_zip("digests", "ends", sizes.alias("sizes"))).alias("pos", "c"))
    return exploded.select("seq", "doc_id", "start", "n_tokens", "n_chunks", "pos", F.col("c.digests").alias("digest"), F.col("c.sizes").alias("size"), (F.col("n_tokens") - F.col("c.ends")).alias("after"))


def read_summaries(store: Store, spark: SparkSession) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Every chunk is read and hashed once; its CRC-32 is moved to its places in the documents, where the parts XOR to
    the whole document's. Damaged and missing chunks, chunks whose length their recipe doesn't give, and recipes whose
    id, place, lengths or digests the manifest doesn't match, fail.
    """

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, n_bytes: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(), n_bytes.to_numpy()).astype(np.int64))

    manifest = store.manifest(spark)
    apart = _merkle(store.recipes(spark)).withColumn("side", F.lit(1)).unionByName(manifest.withColumn("side", F.lit(2)))
    if apart.groupBy("level", "node", "hash").agg(F.sum("side").alias("sides")).where("sides <> 3").limit(1).count():
        raise ValueError("recipes and manifest disagree")
    chunks = store.chunks(spark).mapInArrow(_checked, "digest binary, n long, crc long")
    whole = (
        _placed(store, spark)
        .join(chunks, "digest", "left")
        .select("seq", "doc_id", "start", "n_tokens", "n_chunks", "n", "size", shifted(F.coalesce("crc", F.lit(0)), F.col("after") * 4).alias("part"))
        .groupBy("seq", "doc_id", "start", "n_tokens", "n_chunks")
        .agg(F.bit_xor("part").alias("ids_crc32"), F.sum("n").alias("found"), F.count_if(F.col("n") == F.col("size")).alias("found_chunks"))
    )
    sound = (F.col("found") == F.col("n_tokens")) & (F.col("found_chunks") == F.col("n_chunks"))
    return whole.select("doc_id", "start", "n_tokens", F.when(sound, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a chunk is missing or of another length"))).alias("ids_crc32"))


def read_ids(store: Store, spark: SparkSession) -> DataFrame:
    """doc_id, start, n_tokens and ids (array of int) of every document, rebuilt from recipes and chunks."""

    @F.pandas_udf("array<int>")
    def unpacked(width: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, f"<u{w}").astype(np.int32) for w, x in zip(width, ids, strict=True)])

    rows = _placed(store, spark).join(store.chunks(spark), "digest").select("seq", "doc_id", "start", "n_tokens", "pos", unpacked("width", "ids").alias("part"))
    whole = rows.groupBy("seq", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    return whole.select("doc_id", "start", "n_tokens", F.flatten(F.col("parts.part")).alias("ids"))
