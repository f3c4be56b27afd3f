"""Filter interaction audit: what each filter of a cascade removes, in every order, from one table of failure masks.

Documents become masks of the filters they fail. Counts by part and mask (at most 32 rows a part) hold all that any
order can show, so texts are read once and only ids, hashes and masks are shuffled. A Gray-code walk over the 32
subsets of filters toggles one filter at a time: each mask cell counts its active failures, a cell leaves or rejoins the
survivors when its counter leaves or reaches zero, and the survivors of all 32 states are stored. A step of an order is
the difference of two states.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import columns, materialise, slices

FILTERS = "ABCDE"
_CAPITALS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(rb"[#$%&*|]")
#: Words a document needs, and the shares in percent of distinct words (at least) and capitals (at most).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Of each mask cell: documents, those labelled good, those labelled toxic.
MEASURES = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(data: bytes) -> int:
    """Bits 0 to 3 for the filters A to D that a text fails."""
    words = data.split()
    chars = int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * chars, _SYMBOLS.search(data) is not None)
    return sum(failed << i for i, failed in enumerate(fails))


def _mask(text: Column) -> Column:
    @F.arrow_udf("int")
    def masks(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            done = [text_failures(t or b"") for piece in slices(pa.RecordBatch.from_arrays([part], names=["text"])) for t in piece["text"].cast(pa.binary()).to_pylist()]
            yield pa.array(done, pa.int32())

    return masks(text)


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of failed filters, counted before anything is joined twice.

    Filter E fails where a smaller doc_id holds the same text (by SHA-256). A text's first documents are found by an
    aggregate over its hash and joined back by hash and id, so thousands of copies never meet in one task.
    """
    text = F.coalesce("text", F.lit(""))
    read = columns(docs, doc_id="doc_id", text="text", source="source")
    rows = read.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), _mask(F.col("text")).alias("mask"), F.unhex(F.sha2(text, 256)).alias("hash"))
    rows = materialise(rows.groupBy("doc_id", "part", "mask", "hash").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    marks = columns(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    firsts = rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    joined = rows.join(marks, "doc_id", "left").join(firsts, ["hash", "doc_id"], "left")
    again = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << FILTERS.index("E")).otherwise(0)
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in MEASURES[1:]]]
    return joined.groupBy("part", (F.col("mask") + again).alias("mask")).agg(*sums)


def subset_states(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters, (32, parts, measures), from cells (parts, 32 masks, measures), by a Gray-code walk."""
    n = cells.shape[1]
    counter, alive = np.zeros(n, np.int64), cells.sum(axis=1)
    states, active = np.empty((n, *alive.shape), np.int64), 0
    states[0] = alive
    masks = np.arange(n)
    for step in range(1, n):
        bit = step & -step
        active ^= bit
        failing = masks & bit != 0
        before = counter > 0
        counter[failing] += 1 if active & bit else -1
        gone, back = ~before & (counter > 0), before & (counter == 0)
        alive = alive - cells[:, gone].sum(axis=1) + cells[:, back].sum(axis=1)
        states[active] = alive
    return states


def order_steps(cells: np.ndarray) -> dict[str, np.ndarray]:
    """For parts' cells the columns of SCHEMA after part, each (parts, orders * steps)."""
    states, size = subset_states(cells), len(FILTERS)
    bits = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    after = np.bitwise_or.accumulate(bits, axis=1)
    lost = states[after ^ bits] - states[after]  # (orders, steps, parts, measures)
    fails = np.stack([states[0] - states[1 << i] for i in range(size)])[..., 0]
    alone = np.stack([states[(1 << size) - 1 - (1 << i)] - states[(1 << size) - 1] for i in range(size)])[..., 0]
    own = np.log2(bits).astype(int)
    shapley = np.stack([lost[..., 0][own == i].sum(axis=0) for i in range(size)])
    found = {"kept": states[after][..., 0], "removed": lost[..., 0], "redundant": fails[own] - lost[..., 0], "unique_fails": alone[own], "good_lost": lost[..., 1], "toxic_lost": lost[..., 2], "shapley": shapley[own]}
    return {k: v.reshape(-1, cells.shape[0]).T for k, v in found.items()}


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size, rows = len(FILTERS), len(ORDERS) * len(FILTERS)
    orders = np.repeat(ORDERS, size).tolist()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64).to_pylist()
            cells = np.zeros((len(some), 1 << size, len(MEASURES)), np.int64)
            for i, row in enumerate(some):
                for cell in row["cells"]:
                    cells[i, cell["mask"]] = [cell[m] for m in MEASURES]
            found = order_steps(cells)
            steps = np.tile(np.arange(1, size + 1, dtype=np.int32), len(some) * len(ORDERS))
            heads = [pa.array([row["part"] for row in some for _ in range(rows)], pa.string()), pa.array(orders * len(some), pa.string()), pa.array(steps)]
            yield pa.RecordBatch.from_arrays([*heads, *[pa.array(v.ravel()) for v in found.values()]], names=[f.split()[0] for f in SCHEMA.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SCHEMA: for each part (source value), order of the five filters and step what the step's filter does.

    Null texts are empty (they fail A), null sources the empty part. Rows that repeat a doc_id count each; a null
    doc_id has no label and never fails E, and no text is a copy of it. A document is good or toxic if any of its
    label rows says so. An empty table gives no rows; further columns are ignored.
    """
    cells = failure_masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    return cells.mapInArrow(_walked, SCHEMA)
