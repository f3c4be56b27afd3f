"""Mixture-controlled packing: deficit round-robin over source queues.

Each window adds a quantum of credit to every source queue in proportion to its target, a queue gives as many tokens
as its credit covers, and what is left of the credit (under one token) carries over to the next window. A queue that
runs dry leaves its share to the others in proportion. The credit of a queue after window k has a closed form, so
every task knows the deficits carried into its windows from totals alone, and no task waits for another: documents
are encoded once to a staged table, totals by (task, source) give each document's place in its queue, and a second
scan cuts the pieces. Rows are never shuffled.

Queues. A source has a queue of its own if a target names it or, without targets, if it holds at least one token in
LEAST_SHARE of the corpus. There can be no more than LEAST_SHARE such sources; all smaller ones, however many, share
TAILS queues by a hash of their name, so totals and windows have a bound at every size and no source is refused.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import columns, scratch_path, slices
from spindrift.llm.word_ids import encoder

SEQUENCE = 1024
#: Tokens of a mixing window: documents are cut at its segments, so longer windows cut fewer.
WINDOW = 64 * SEQUENCE
#: A source with less than one in so many tokens (16 of a window) shares a queue; and how many queues such sources share.
LEAST_SHARE, TAILS = 4096, 512
#: Rows of the table of queue offsets up to which it is broadcast (some 100 bytes each); beyond that it is joined.
BROADCAST_ROWS = 100_000
STAGED = "doc_id long, source string, task int, task_start long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


class Mixture:
    """The closed form of the round-robin: what each queue has given by the end of each window.

    totals: tokens by queue. targets: weight by queue, by default its share of all tokens. A queue without a weight,
    or with none above 0, gives its tokens after all others are used up. All arithmetic is exact.
    """

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW) -> None:
        self.names = sorted(totals)
        self.at = {s: i for i, s in enumerate(self.names)}
        self.totals = [totals[s] for s in self.names]
        self.window = window
        self.n_windows = -(-sum(self.totals) // window)
        shares = [Fraction(targets.get(s, 0) if targets else totals[s]) for s in self.names]
        scale = lcm(*(w.denominator for w in shares))
        self.weights = [int(w * scale) for w in shares]
        self.phases = self._phases()
        self.starts = [p[0] for p in self.phases]
        self.window_state = lru_cache(256)(self._window_state)

    def _phases(self) -> list[tuple]:
        """(tokens given before, tokens of dry queues, weight of the active ones, their first and end rank), in order; queues rank by when they run dry."""
        phases, self.rank, base = [], {}, 0
        todo = [i for i, t in enumerate(self.totals) if t > 0]
        for group in ([i for i in todo if self.weights[i] > 0], [i for i in todo if self.weights[i] <= 0]):
            for i in group:
                self.weights[i] = self.weights[i] if self.weights[i] > 0 else self.totals[i]
            dry = {i: Fraction(self.totals[i], self.weights[i]) for i in group}
            active = sorted(group, key=lambda i: (dry[i], i))
            first, weight, given = len(self.rank), sum(self.weights[i] for i in active), Fraction(base)
            self.rank |= {i: first + k for k, i in enumerate(active)}
            k = 0
            while k < len(active):
                phases.append((given, base, weight, first + k, first + len(active)))
                time = dry[active[k]]
                given = base + time * weight
                while k < len(active) and dry[active[k]] <= time:
                    base, weight, k = base + self.totals[active[k]], weight - self.weights[active[k]], k + 1
        return phases

    def given(self, queue: int, window: int) -> int:
        """Tokens the queue has given before the window."""
        tokens = window * self.window
        if window >= self.n_windows:
            return self.totals[queue]
        if not self.phases or tokens <= 0 or not self.totals[queue]:
            return 0
        _, base, weight, first, end = self.phases[bisect_right(self.starts, tokens) - 1]
        if self.rank[queue] < first:
            return self.totals[queue]
        return min(self.totals[queue], self.weights[queue] * (tokens - base) // weight) if self.rank[queue] < end else 0

    def _window_state(self, window: int) -> tuple[list[int], list[int]]:
        """Tokens given before the window by queue, and the position in the output where each queue's segment starts."""
        before = [self.given(i, window) for i in range(len(self.names))]
        after = [self.given(i, window + 1) for i in range(len(self.names))]
        at, places = sum(before), []
        for b, a in zip(before, after, strict=True):
            places.append(at)
            at += a - b
        return before, places

    def window_of(self, source: int, token: int) -> int:
        """The window that takes this token of the queue."""
        low, high = 0, max(0, self.n_windows - 1)
        while low < high:
            mid = (low + high) // 2
            if self.given(source, mid + 1) > token:
                high = mid
            else:
                low = mid + 1
        return low

    def pieces(self, source: int, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(tokens of the document before, length, place in the output) of a document at start of its queue, cut at segments and sequences."""
        done, window = 0, self.window_of(source, start)
        while done < length:
            before, places = self.window_state(window)
            room = self.given(source, window + 1) - (start + done)
            place = places[source] + start + done - before[source]
            left = min(length - done, room)
            while left > 0:
                n = min(left, SEQUENCE - place % SEQUENCE)
                yield done, n, place
                done, place, left = done + n, place + n, left - n
            window += 1


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, given = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in (part for whole in batches for part in slices(whole)):
            ids, counts = enc.encode_ended(batch["text"].to_pylist(), end_id)
            starts = []
            for s, n in zip(batch["source"].to_pylist(), counts.tolist(), strict=True):
                starts.append(given.get(s, 0))
                given[s] = starts[-1] + n
            ends = np.cumsum(counts)
            raw, wide = ids.astype("<u2").tobytes(), np.maximum.reduceat(ids, ends - counts) > 65535 if len(ids) else np.zeros(0, bool)
            held = [b"\xff" + ids[e - n : e].tobytes() if w else raw[2 * (e - n) : 2 * e] for w, n, e in zip(wide.tolist(), counts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], pa.array(np.full(len(held), task, np.int32)), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(held, pa.binary())], schema=_STAGED)

    return run


_STAGED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("task", pa.int32()), ("task_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("source", pa.string()), ("ids", pa.binary())])


def _wide(packed: bytes, n: int) -> bytes:
    """Staged ids as little-endian 32-bit integers: 16-bit ones, or a mark and 32-bit ones (their length tells)."""
    return np.frombuffer(packed, "<u2").astype("<u4").tobytes() if len(packed) == 2 * n else packed[1:]


def _cut(mixture_args: tuple, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(*mixture_args)
        for batch in (part for whole in batches for part in slices(whole, "ids")):
            out = []
            for doc, source, queue, start, n, packed in zip(*batch.to_pydict().values(), strict=True):
                ids = _wide(packed, n)
                for done, length, place in mixture.pieces(mixture.at[queue], start, n):
                    piece = ids[4 * done : 4 * (done + length)]
                    out.append((doc, done, length, zlib.crc32(piece), n, place // SEQUENCE, place % SEQUENCE, source, piece if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)] if out else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, targets: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids (packed 32-bit).

    Every token of every row lies in one piece. All sequences are full but the last, which alone is padded. Null text
    counts as empty (one piece, the end id); a null source counts as the empty name; repeated rows are packed each;
    an empty table gives no rows; further columns are ignored. targets (a weight by source, a dict the caller holds)
    sets the proportions of every window for as long as the sources last; the others follow behind.
    """
    spark = docs.sparkSession
    staged_path = scratch_path(spark, "packing")
    docs = columns(docs, doc_id=doc_id, source=source, text=text).select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    docs.mapInArrow(_encode(tokenizer, end_id), STAGED).write.option("compression", "zstd").parquet(staged_path)
    staged = spark.read.schema(STAGED).parquet(staged_path)
    by_task = staged.groupBy("source", "task").agg(F.sum("n_tokens").alias("tokens"))
    by_source = by_task.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    own = list(targets) if targets else [r.source for r in by_source.where(F.col("tokens") * LEAST_SHARE >= (by_source.agg(F.sum("tokens")).first()[0] or 0)).select("source").collect()]
    queue = F.when(F.col("source").isin(own), F.concat(F.lit("own "), "source")).otherwise(F.concat(F.lit("tail "), F.pmod(F.xxhash64("source"), F.lit(TAILS)).cast("string")))
    totals = {r.queue: r.tokens for r in by_source.groupBy(queue.alias("queue")).agg(F.sum("tokens").alias("tokens")).collect()}
    earlier = Window.partitionBy("queue").orderBy("source", "task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("queue", queue).select("source", "task", "queue", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    if by_task.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = staged.join(offsets, ["source", "task"]).select("doc_id", "source", "queue", (F.col("base") + F.col("task_start")).alias("at"), "n_tokens", "ids")
    return placed.mapInArrow(_cut((totals, {f"own {s}": w for s, w in targets.items()} if targets else None, window), with_ids), PIECES)
