"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

A snapshot holds the distinct digests of documents seen so far in buckets, each bucket with a 3-wise binary-fuse
filter of 8-bit fingerprints. The distinct digests of a new batch (grouped on their own first, with map-side
combining, so that a hot text is one row) pass the filters bucket by bucket. Only positives join the snapshot's
exact digests, and a positive counts only if the bytes of both texts agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import ascii_lower, columns, materialise

#: Digests a filter holds on average; a bucket is one group of one task.
KEYS_PER_BUCKET = 200_000
FILTER_SCHEMA = "bucket int, seed long, segment int, n_segments int, fingerprints binary"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over wrapping arithmetic."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(keys: np.ndarray, seed: int, segment: int, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's three slots, in neighbouring segments, and its fingerprint."""
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(n_segments)) >> np.uint64(32)
    inner = [_mix(h, 0x9E3779B97F4A7C15 * i % 2**64) & np.uint64(segment - 1) for i in (1, 2, 3)]
    slots = np.stack([(first + np.uint64(i)) * np.uint64(segment) + inner[i] for i in range(3)])
    return slots.astype(np.int64), (h ^ (h >> np.uint64(29))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, first segments, fingerprints) of distinct 64-bit keys; any number of keys, none included."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    size = max(3 * segment, int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 4)))) + 3 * segment)
    for seed in range(1, 200):
        n_segments = -(-size // segment)
        slots, prints = _slots(keys, seed, segment, n_segments)
        total = (n_segments + 2) * segment
        count, owner = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for row in slots:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(owner, row, np.arange(n))
        left, rounds = np.ones(n, bool), []
        while left.any():
            single = np.flatnonzero(count == 1)
            peeled, at = np.unique(owner[single], return_index=True)
            if not len(peeled):
                break
            rounds.append((peeled, single[at]))
            left[peeled] = False
            for row in slots:
                np.subtract.at(count, row[peeled], 1)
                np.bitwise_xor.at(owner, row[peeled], peeled)
        if left.any():
            size += size // 20 + segment
            continue
        table = np.zeros(total, np.uint8)
        for peeled, at in reversed(rounds):
            # A peeled key owns its slot alone among the keys peeled then or later, so a round is filled at once.
            rest = np.bitwise_xor.reduce(table[slots[:, peeled]], axis=0) ^ table[at]
            table[at] = prints[peeled] ^ rest
        return seed, segment, n_segments, table.tobytes()
    raise ValueError("no seed gave a filter")


def probe_filter(keys: np.ndarray, seed: int, segment: int, n_segments: int, fingerprints: bytes) -> np.ndarray:
    """True for every key that went in and for about one in 256 others."""
    slots, prints = _slots(keys.astype(np.uint64), seed, segment, n_segments)
    return np.bitwise_xor.reduce(np.frombuffer(fingerprints, np.uint8)[slots], axis=0) == prints


@dataclass(frozen=True)
class Snapshot:
    """Distinct digests (digest, rep_id, n, bucket) and one filter row a bucket; both tables are never changed."""

    digests: DataFrame
    filters: DataFrame
    n_buckets: int
    keys_per_bucket: int


def _bucket(n_buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int")


def _key64(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digest), ">u8").astype(np.uint64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, n_segments, table = build_filter(_key64(pdf.digest))
    return pd.DataFrame([(pdf.bucket.iat[0], seed, segment, n_segments, table)], columns=["bucket", "seed", "segment", "n_segments", "fingerprints"])


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if len(batch) and len(filters):
        f = filters.iloc[0]
        return batch[probe_filter(_key64(batch.digest), int(f.seed), int(f.segment), int(f.n_segments), f.fingerprints)][["digest"]]
    return pd.DataFrame({"digest": pd.Series([], dtype=object)})


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of the text after lower-casing A-Z."""
    return columns(docs, doc_id=doc_id, text=text).select("doc_id", F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest"))


def group_batch(keyed: DataFrame) -> DataFrame:
    """New-batch duplicates grouped on their own: digest, rep_id (largest doc_id), n."""
    return keyed.groupBy("digest").agg(F.max("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n"))


def snapshot(grouped: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> Snapshot:
    """Freeze grouped digests: written once with the filter of each bucket."""
    grouped = materialise(grouped, "snapshot")
    n_buckets = max(1, -(-grouped.count() // keys_per_bucket))
    grouped = grouped.withColumn("bucket", _bucket(n_buckets))
    filters = materialise(grouped.select("bucket", "digest").groupBy("bucket").applyInPandas(_build, FILTER_SCHEMA), "fuse-filters")
    return Snapshot(grouped, filters, n_buckets, keys_per_bucket)


def screen(grouped: DataFrame, against: Snapshot) -> DataFrame:
    """Digests of a grouped batch that the snapshot may hold: all it does hold, and about 0.4 % of the others.

    A batch that is larger than the snapshot has more digests a bucket than a filter was built for: they are dealt over
    salts, and each salt gets the bucket's filter.
    """
    salts = max(1, -(-grouped.count() // (against.n_buckets * against.keys_per_bucket)))
    batch = grouped.select(_bucket(against.n_buckets).alias("bucket"), F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(salts)).alias("salt"), "digest")
    filters = against.filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return batch.groupBy("bucket", "salt").cogroup(filters.groupBy("bucket", "salt")).applyInPandas(_screen, "digest binary")


def confirm(positives: DataFrame, grouped: DataFrame, against: Snapshot, docs: DataFrame) -> DataFrame:
    """Positives whose digest is in the snapshot's exact bucket and whose texts agree byte by byte: digest. A text
    known only under null ids can't be looked up; there the digest decides."""
    found = (
        grouped.join(positives, "digest", "left_semi")
        .join(against.digests.select("digest", F.col("rep_id").alias("old_id")), "digest")
        .select("digest", F.col("rep_id").alias("new_id"), "old_id")
    )
    sides = found.select("digest", F.explode(F.array("new_id", "old_id")).alias("doc_id"))
    texts = docs.select("doc_id", ascii_lower(F.col("text")).alias("text"))
    agreed = (
        sides.join(texts, "doc_id")
        .where(F.unhex(F.sha2("text", 256)) == F.col("digest"))
        .groupBy("digest")
        .agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .where(F.col("low") == F.col("high"))
    )
    return agreed.select("digest").unionByName(found.where(F.col("new_id").isNull() | F.col("old_id").isNull()).select("digest"))


def exact_groups(snapshot_docs: DataFrame, batch_docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """One row for each row of both inputs: doc_id, keep_id, group_size, kept, text_sha256.

    snapshot_docs become an immutable snapshot, batch_docs are screened against it. The largest doc_id of equal
    texts stays; rows that repeat that doc_id all stay. Null text counts as empty, a null doc_id as the smallest.
    Empty tables give no rows; further columns are ignored.
    """
    docs = columns(snapshot_docs, doc_id=doc_id, text=text).unionByName(columns(batch_docs, doc_id=doc_id, text=text))
    old_keys = materialise(digests(snapshot_docs, doc_id, text), "old-digests")
    new_keys = materialise(digests(batch_docs, doc_id, text), "new-digests")
    old, new = snapshot(group_batch(old_keys), keys_per_bucket), materialise(group_batch(new_keys), "batch-groups")
    same = confirm(screen(new, old), new, old, docs)
    sides = old.digests.select("digest", "rep_id", "n", F.lit(0).alias("part")).unionByName(new.withColumn("part", F.lit(1)))
    groups = (
        sides.join(same.select("digest", F.lit(2).alias("both")), "digest", "left")
        .groupBy("digest", F.coalesce("both", "part").alias("in_part"))
        .agg(F.max("rep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    keyed = old_keys.withColumn("part", F.lit(0)).unionByName(new_keys.withColumn("part", F.lit(1)))
    stays = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return (
        keyed.join(materialise(groups, "groups"), "digest")
        .where((F.col("in_part") == 2) | (F.col("in_part") == F.col("part")))
        .select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def halves(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All rows in two parts, the lower half of the id range (nulls too) as what came first."""
    low, high = docs.agg(F.min(doc_id), F.max(doc_id)).first()
    if low is None:
        return docs, docs.where(F.lit(False))
    cut = low + (high - low) // 2
    return docs.where(F.col(doc_id).isNull() | (F.col(doc_id) <= cut)), docs.where(F.col(doc_id) > cut)
