"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over the whole document, and their responses are pooled (maximum and mean)
in overlapping chunks that cover it to its last byte. A small hidden layer turns each chunk into a logit for poor
text, and the maximum over chunks decides: one poor passage makes a poor document. Fitting uses a bounded sample of
labelled rows on the driver; scoring is one pass over the table without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import columns, slices

#: Embedding size, filter width and step in bytes, filters, hidden units.
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 6, 8, 2, 32, 24
#: Filter positions of half a chunk; a chunk is two neighbouring halves (512 bytes), so chunks overlap by half.
HALF = 128
#: Labelled rows used for fitting, of each label, and bytes of their texts (bounds the driver's memory).
SAMPLE_PER_LABEL, SAMPLE_BYTES = 1500, 24 << 20
EPOCHS, LEAST_STEPS, BATCH, RATE = 10, 1000, 16, 0.005
#: Documents that score below are poor.
LEAST_SCORE = 0.3
#: Bytes convolved at a time.
SLICE = 1 << 18


@dataclass
class Model:
    """Parameters by name."""

    weights: dict[str, np.ndarray]


def new_model(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model({"embed": normal(257, EMBED, scale=0.5), "filters": normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), "w1": normal(2 * FILTERS + 1, HIDDEN, scale=(2 * FILTERS) ** -0.5), "b1": np.zeros(HIDDEN, np.float32), "w2": normal(HIDDEN, scale=HIDDEN**-0.5), "b2": np.zeros(1, np.float32)})


def _codes(text: bytes) -> np.ndarray:
    """Bytes as 1-256, padded with 0 so that filter steps end on the last byte or beyond it."""
    data = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    length = WIDTH + -(-max(0, len(data) - WIDTH) // STEP) * STEP
    return np.concatenate([data, np.zeros(length - len(data), np.int16)])


def _responses(codes: np.ndarray, w: dict) -> np.ndarray:
    """(positions, filters)."""
    embedded = w["embed"][codes]
    n = (len(codes) - WIDTH) // STEP + 1
    windows = np.lib.stride_tricks.as_strided(embedded, (n, WIDTH * EMBED), (STEP * EMBED * 4, 4))
    return windows @ w["filters"]


def _pooled(codes: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each half chunk the maximum and the sum of each filter; halves of HALF positions, the last may be shorter."""
    tops, sums = [], []
    step = SLICE // STEP // HALF * HALF * STEP
    at = 0
    while True:
        r = _responses(codes[at : at + step + WIDTH - STEP], w)
        edges = np.arange(0, len(r), HALF)
        tops.append(np.maximum.reduceat(r, edges, axis=0))
        sums.append(np.add.reduceat(r, edges, axis=0))
        at += step
        if at + WIDTH > len(codes):
            return np.concatenate(tops), np.concatenate(sums)


def _chunks(tops: np.ndarray, sums: np.ndarray, positions: int) -> np.ndarray:
    """Features of each chunk: maxima, means, and how full it is."""
    counts = np.full(len(tops), HALF, np.float32)
    counts[-1] = positions - HALF * (len(tops) - 1)
    if len(tops) > 1:
        tops, sums, counts = np.maximum(tops[:-1], tops[1:]), sums[:-1] + sums[1:], counts[:-1] + counts[1:]
    return np.concatenate([tops, sums / counts[:, None], (counts / (2 * HALF))[:, None]], axis=1)


def _logits(features: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(features @ w["w1"] + w["b1"], 0)
    return hidden @ w["w2"] + w["b2"][0], hidden


def poor_logit(text: bytes, model: Model) -> float:
    codes = _codes(text)
    features = _chunks(*_pooled(codes, model.weights), (len(codes) - WIDTH) // STEP + 1)
    return float(_logits(features, model.weights)[0].max())


def score_text(text: bytes, model: Model) -> float:
    """The probability of label 1."""
    return float(1 / (1 + np.exp(np.clip(poor_logit(text, model), -40, 40))))


def _gradient(text: bytes, poor: int, weight: float, w: dict, grad: dict) -> None:
    """Adds a document's gradient: it flows through the chunk that decides, and in it through each filter's place and mean."""
    codes = _codes(text)
    positions = (len(codes) - WIDTH) // STEP + 1
    features = _chunks(*_pooled(codes, w), positions)
    logits, hidden = _logits(features, w)
    c = int(logits.argmax())
    d = weight * (1 / (1 + np.exp(-np.clip(logits[c], -40, 40))) - poor)
    grad["b2"] += d
    grad["w2"] += d * hidden[c]
    dh = d * w["w2"] * (hidden[c] > 0)
    grad["b1"] += dh
    grad["w1"] += np.outer(features[c], dh)
    df = w["w1"] @ dh
    part = codes[c * HALF * STEP : (c * HALF + 2 * HALF - 1) * STEP + WIDTH]
    n = (len(part) - WIDTH) // STEP + 1
    embedded = w["embed"][part]
    windows = np.ascontiguousarray(np.lib.stride_tricks.as_strided(embedded, (n, WIDTH * EMBED), (STEP * EMBED * 4, 4)))
    at = (windows @ w["filters"]).argmax(axis=0)
    dr = np.repeat((df[FILTERS : 2 * FILTERS] / n)[None, :], n, axis=0).astype(np.float32)
    dr[at, np.arange(FILTERS)] += df[:FILTERS]
    grad["filters"] += windows.T @ dr
    dw = (dr @ w["filters"].T).reshape(n, WIDTH, EMBED)
    place = part[np.arange(n)[:, None] * STEP + np.arange(WIDTH)[None, :]].ravel()
    for e in range(EMBED):
        grad["embed"][:, e] += np.bincount(place, dw[:, :, e].ravel(), 257)


def fit(texts: list[bytes], labels: list[int], poor_odds: float = 1.0, seed: int = 7) -> Model:
    """Adam over the sample, classes weighted alike in total; poor_odds then moves the last bias to the odds of the labelled rows."""
    model, rng = new_model(seed), np.random.default_rng(seed)
    w = model.weights
    poor = np.array([1 - int(x) for x in labels])
    if not len(poor) or poor.min() == poor.max():
        w["w2"][:] = 0
        w["b2"][:] = 0 if not len(poor) else (4 if poor[0] else -4)
        return model
    share = np.where(poor == 1, 0.5 / poor.mean(), 0.5 / (1 - poor.mean()))
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    a_pass = -(-len(texts) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // a_pass))
    step, total = 0, epochs * a_pass
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            step += 1
            grad = {k: np.zeros(v.shape, np.float64) for k, v in w.items()}
            some = order[at : at + BATCH]
            for i in some:
                _gradient(texts[i], int(poor[i]), float(share[i]), w, grad)
            rate = RATE * min(1, step / 20) * (1 - step / (total + 1)) ** 0.5
            for k in w:
                g = (grad[k] / len(some) + 1e-5 * w[k]).astype(np.float32)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    w["b2"] += np.float32(np.log(poor_odds))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never used for fitting: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit_on(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, most_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model fitted on up to per_label rows of each label and most_bytes of their texts, taken in order of a hash of the id, none held out.

    Each label has half of most_bytes; a text that doesn't fit into what is left of it is skipped, and those behind it
    may still fit. Up to three candidates for each place are looked at. Null ids, texts and labels are left out, a row
    that repeats an id, label and text counts once; without both labels every score is the same.
    """
    wanted = columns(labels, doc_id=doc_id, label=label).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    counts = {r.label: r["count"] for r in wanted.groupBy("label").count().collect()}
    odds = counts.get(0, 0) / counts[1] if counts.get(0) and counts.get(1) else 1.0
    some = None
    for value in (0, 1):
        # Half as many again, for ids without a text.
        part = wanted.where(F.col("label") == value).withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(per_label * 3 // 2)
        some = part if some is None else some.unionByName(part)
    texts = columns(docs, doc_id=doc_id, text=text).select("doc_id", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash")).where(F.col("size") <= most_bytes // 2)
    sized = texts.drop("text").join(F.broadcast(some), "doc_id").select("label", "at", "doc_id", "size", "hash").distinct()
    nth = F.row_number().over(Window.partitionBy("label").orderBy("at", "doc_id", "size", "hash"))
    chosen, taken, used = [], {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in sorted(sized.withColumn("n", nth).where(F.col("n") <= 3 * per_label).drop("n").collect()):
        if taken[r.label] < per_label and used[r.label] + r["size"] <= most_bytes // 2:
            taken[r.label], used[r.label] = taken[r.label] + 1, used[r.label] + r["size"]
            chosen.append(tuple(r))
    sample = docs.sparkSession.createDataFrame(chosen, T.StructType([sized.schema[c] for c in sized.columns]))
    taken = texts.join(F.broadcast(sample), ["doc_id", "size", "hash"]).distinct()
    rows = sorted(taken.select("label", "at", "doc_id", "text").collect())
    return fit([r.text.encode() for r in rows], [r.label for r in rows], odds)


def score_column(text: Column, model: Model) -> Column:
    """The score of a text: only the text goes to Python and only the score comes back."""

    @F.arrow_udf("double")
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            done = [score_text((t or "").encode(), model) for piece in slices(pa.RecordBatch.from_arrays([part], names=["text"])) for t in piece["text"].to_pylist()]
            yield pa.array(done, pa.float64())

    return scores(text)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs and score (0 to 1, higher: label 1 likelier); a column of that name is replaced.

    Whole texts are read; null counts as empty, and empty texts get the model's score of an empty chunk. Repeated rows
    are scored each, an empty table gives no rows.
    """
    return docs.withColumn("score", score_column(F.col(f"`{text}`"), model))
