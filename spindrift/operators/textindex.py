"""Full-text search over an inverted index: English stems, web-style queries, phrases and a weighted rank.

The index is a Parquet folder: postings (a stem's documents with all its places, in blocks) in folders of buckets,
sorted by stem inside, and the documents themselves. A search names its stems' buckets, so the scan reads those folders
alone and skips row groups of other stems; everything after works on the documents that hold one of them. A frequent
stem's postings are split over files and tasks when written, and meet by document, not by stem, when searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.stem import ENGLISH_STOPS, stem
from spindrift.scratch import exists

#: Weights of the fields A to D.
WEIGHTS = (1.0, 0.4, 0.2, 0.1)
BUCKETS = 64
#: Bytes of text that a task turns into postings at a time.
PIECE = 8 << 20
#: Places that a search unpacks at a time, and documents whose places are Python objects at a time.
PLACES, RANKED = 1 << 18, 256
#: Places further apart than this add next to nothing to a rank of words together; how little, and the sum of 1/n**2.
FAR, FAR_SHARE, SERIES = 100, 1e-30, 1.64493406685
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_STOPS = frozenset(ENGLISH_STOPS)


def stems_of(text: str) -> list[tuple[str, int]]:
    """(stem, place) of a text's words that are no stop words; places count from 1 and stop words take one each."""
    return [(stem(w), i) for i, w in enumerate(_WORD.findall(text.lower()), 1) if w not in _STOPS]


@dataclass(frozen=True)
class Phrase:
    """Stems and the distance of each from the first; a word is a phrase of one."""

    wanted: bool
    stems: tuple[tuple[str, int], ...]


def parse_query(text: str) -> list[list[Phrase]]:
    """Alternatives of phrases that must all hold or, behind '-', not hold: words are joined by and, 'or' separates, quotes keep phrases.

    Stop words are left out of the query; an alternative of stop words alone goes.
    """
    out: list[list[Phrase]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|(\S+))', text):
        if word.lower() == "or" and not minus:
            out.append([])
        elif found := stems_of(quoted or word):
            out[-1].append(Phrase(not minus, tuple((s, at - found[0][1]) for s, at in found)))
    return [group for group in out if group]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose fields hold about PIECE bytes."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
    ends, at = np.cumsum(sizes + 64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _words(field: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, position from 1, stem number or -1 for a stop word) of a field's words, and the stems."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(field, "")), pattern=r"[^\p{L}\p{M}\p{N}]+")
    rows, words = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten()
    held = pc.greater(pc.binary_length(words), 0)
    rows, words = rows[held.to_numpy(zero_copy_only=False)], words.filter(held).dictionary_encode()
    starts = np.searchsorted(rows, rows)
    stems: dict[str, int] = {}
    kinds = np.array([-1 if w in _STOPS else stems.setdefault(stem(w), len(stems)) for w in words.dictionary.to_pylist()], np.int64)
    return rows, np.arange(1, len(rows) + 1) - starts, kinds[words.indices.to_numpy()] if len(rows) else np.zeros(0, np.int64), list(stems)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (term, docs, counts, places) of batches whose first column is the document and whose others are its fields.

    A block holds the documents of a stem in a few megabytes of text: how many places each has, and the places, which are
    4 * position + field. Positions of a field follow those of the one before.
    """
    for batch in batches:
        for piece in _pieces(batch):
            terms: dict[str, int] = {}
            found, start = [], np.zeros(piece.num_rows, np.int64)
            for field in range(piece.num_columns - 1):
                rows, positions, kinds, stems = _words(piece.column(field + 1))
                keep = kinds >= 0
                rows, positions = rows[keep], positions[keep]
                own = np.array([terms.setdefault(s, len(terms)) for s in stems] or [0], np.int64)
                found.append((own[kinds[keep]], rows, 4 * (start[rows] + positions) + field))
                last = np.zeros(piece.num_rows, np.int64)
                np.maximum.at(last, rows, positions)
                start += last
            term, row, place = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(term):
                continue
            order = np.lexsort((place, row, term))
            term, row, place = term[order], row[order], place[order]
            posting = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])]))
            block = np.flatnonzero(np.concatenate([[True], term[posting][1:] != term[posting][:-1]]))
            counts = np.diff(np.append(posting, len(term))).astype(np.int32)
            ends = pa.array(np.append(block, len(posting)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(terms), pa.string()).take(pa.array(term[posting][block])),
                    pa.ListArray.from_arrays(ends, piece.column(0).take(pa.array(row[posting]))),
                    pa.ListArray.from_arrays(ends, pa.array(counts)),
                    pa.ListArray.from_arrays(pa.array(np.append(posting[block], len(term)).astype(np.int32)), pa.array(place.astype(np.int32))),
                ],
                names=["term", "docs", "counts", "places"],
            )


def _runs(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lists hold about most values in all."""
    ends, at = np.cumsum(pc.fill_null(pc.list_value_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, term, places, write), a row for each posting of blocks."""
    for batch in (b for whole in batches for b in _runs(whole, "places", PLACES)):
        docs, counts = batch["docs"], batch["counts"].flatten().to_numpy(zero_copy_only=False)
        of = pa.array(np.repeat(np.arange(batch.num_rows), docs.value_lengths().to_numpy(zero_copy_only=False)))
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        places = pa.ListArray.from_arrays(ends, batch["places"].flatten())
        yield pa.RecordBatch.from_arrays([docs.flatten(), batch["term"].take(of), places, batch["write"].take(of)], names=["doc", "term", "places", "write"])


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """Where an index lies, and how many writes it has seen: rows of a later write take the place of earlier ones of the same document."""

    path: str
    writes: int = 0

    def add(self, docs: DataFrame, ident: str, fields: list[Column]) -> Index:
        """The index after documents (ident and up to four fields, the weightiest first) are written to it, new or anew.

        Null fields are empty, a document of no words is found by exclusions alone, null idents are left out. Idents are
        unique within a write.
        """
        if not 1 <= len(fields) <= len(WEIGHTS):
            raise ValueError("one to four fields")
        rows = docs.select(F.col(ident).alias("doc"), *[f.cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).where("doc IS NOT NULL")
        blocks = f"term string, docs array<{rows.schema['doc'].dataType.simpleString()}>, counts array<int>, places array<int>"
        dealt = rows.mapInArrow(_postings, blocks).withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/postings/write={self.writes}")
        rows.select("doc").write.parquet(f"{self.path}/documents/write={self.writes}")
        return Index(self.path, self.writes + 1)

    def documents(self, spark: SparkSession) -> DataFrame:
        """(doc, write): every document and its last write."""
        found = spark.read.parquet(f"{self.path}/documents")
        return found.groupBy("doc").agg(F.max("write").alias("write"))

    def postings(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """(doc, term, places, write) of the given stems alone: only their buckets' folders are listed and read."""
        buckets = spark.sql("SELECT array_distinct(transform(:terms, t -> pmod(xxhash64(t), :n)))", args={"terms": terms, "n": BUCKETS}).first()[0]
        paths = [f"{self.path}/postings/write={w}/bucket={b}" for w in range(self.writes) for b in buckets]
        paths = [p for p in paths if exists(spark, p)]
        kind = dict(spark.read.parquet(f"{self.path}/documents").dtypes)["doc"]
        rows = f"doc {kind}, term string, places array<int>, write int"
        if not paths:
            return spark.createDataFrame([], rows)
        found = spark.read.schema(f"term string, docs array<{kind}>, counts array<int>, places array<int>, write int").option("basePath", f"{self.path}/postings").parquet(*paths)
        return found.where(F.col("term").isin(terms)).mapInArrow(_unpacked, rows)


def phrase_at(places: list[np.ndarray], stems: tuple[tuple[str, int], ...], order: dict[str, int]) -> bool:
    """Whether a phrase's stems stand at their distances anywhere."""
    starts = None
    for term, offset in stems:
        here = places[order[term]] // 4 - offset
        starts = here if starts is None else np.intersect1d(starts, here)
        if not len(starts):
            return False
    return True


def rank_any(places: list[np.ndarray]) -> float:
    """The mean over stems of their places' weights, the best in full and the n-th otherwise by 1 / n**2, scaled by the sum of that series."""
    total = 0.0
    for here in places:
        if len(here):
            w = np.take(WEIGHTS, here % 4)
            best, n = int(w.argmax()), np.arange(1, len(w) + 1)
            total += (w[best] + (w / n**2).sum() - w[best] / (best + 1) ** 2) / SERIES
    return total / len(places)


def rank_all(places: list[np.ndarray]) -> float:
    """How close the stems stand: each pair of places adds the root of its weights and nearness, as independent chances do."""
    if len(places) < 2:
        return rank_any(places)
    rest, pairs = 0.0, 0
    for a, b in combinations([p for p in places if len(p)], 2):
        at, other = a // 4, b // 4
        low, high = np.searchsorted(other, at - FAR), np.searchsorted(other, at + FAR, "right")
        left = np.repeat(np.arange(len(a)), high - low)
        right = np.arange(len(left)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        gap = np.abs(at[left] - other[right])
        near = gap > 0
        w = np.take(WEIGHTS, a[left] % 4) * np.take(WEIGHTS, b[right] % 4) / (1.005 + 0.05 * np.exp(gap / 1.5 - 2))
        rest += np.log1p(-np.sqrt(w[near])).sum()
        pairs += int(near.sum())
        # Far pairs are counted by their weights, not listed.
        close = np.bincount((a[left] % 4) * 4 + b[right] % 4, minlength=16)
        far = np.outer(np.bincount(a % 4, minlength=4), np.bincount(b % 4, minlength=4)).ravel() - close
        rest += (far * np.log1p(-np.sqrt(np.outer(WEIGHTS, WEIGHTS).ravel() * FAR_SHARE))).sum()
        pairs += int(far.sum())
    return float(-np.expm1(rest)) if pairs else 1e-20


def judge(places: list[np.ndarray], groups: list[list[Phrase]], order: dict[str, int]) -> float | None:
    """The rank of a document that meets the query, else None. One group of several stems ranks them together, else each counts alone."""
    if not any(all(phrase_at(places, p.stems, order) == p.wanted for p in group) for group in groups):
        return None
    together = len(groups) == 1 and (len(groups[0]) > 1 or len(groups[0][0].stems) > 1)
    return rank_all(places) if together else rank_any(places)


def search(spark: SparkSession, index: Index, query: str) -> DataFrame:
    """(doc, rank) of the documents that meet a web-style query; no order. A query without words finds nothing.

    An alternative of exclusions alone also finds documents that hold none of the query's stems, with rank 0.
    """
    groups = parse_query(query)
    order = {t: i for i, t in enumerate(sorted({s for g in groups for p in g for s, _ in p.stems}))}
    if not groups:
        return index.documents(spark).where(F.lit(False)).select("doc", F.lit(0.0).alias("rank"))
    found = index.postings(spark, list(order))
    if index.writes > 1:  # a document written again has rows of an earlier write
        live = index.documents(spark)
        found = found.join(live, ["doc", "write"], "left_semi")
    held = found.groupBy("doc").agg(*[F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"p{i}") for t, i in order.items()])
    # Documents without a wanted stem of any group need no look at their places.
    needs = [[F.col(f"p{order[s]}").isNotNull() for p in g if p.wanted for s, _ in p.stems] for g in groups]
    could = F.lit(False)
    for need in needs:
        every = F.lit(True)
        for c in need:
            every = every & c
        could = could | every
    held = held.where(could)
    if not all(needs):
        held = index.documents(spark).select("doc").join(held, "doc", "left")

    @F.arrow_udf("double")
    def rank(*columns: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(columns[0]), RANKED):
            lists = [c.slice(at, RANKED).to_pylist() for c in columns]
            found += [judge([np.array(p or (), np.int64) for p in row], groups, order) for row in zip(*lists, strict=True)]
        return pa.array(found, pa.float64())

    ranked = held.select("doc", rank(*[F.col(f"p{i}") for i in range(len(order))]).alias("rank"))
    return ranked.where(F.col("rank").isNotNull())
