"""Quality rules: compression bands over whole documents and fixed chunks, beside counts of words, symbols and repeats.

Repetitive text compresses far better than prose of its length, encoded or random text hardly at all. A document's
zstandard ratio (compressed bytes over bytes) is held to the limits of its length, as short texts compress worse, and
so is the ratio of each fixed chunk: a document whose whole hides a repetitive or incompressible stretch fails by the
share of its chunks. Only the text goes to Python and only the figures come back; there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import columns, slices

#: Bytes of a text whose words are Python objects at a time.
PART = 4 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Words of a window, and what fails a document before its compression is looked at.
WINDOW, LEAST_WORDS, MOST_REPEAT_PERCENT = 5, 10, 20


@dataclass(frozen=True)
class Limits:
    """bands: (from so many bytes, least ratio, most ratio); shorter texts than the first have no limits.

    Clean prose of the given tables lies between 0.54 and 0.75 at 256 bytes and 0.40 and 0.43 at 16 kB; the limits
    keep a wide distance to it, so that code, tables and other languages stay. Chunks are compressed alone, each held
    to the band of its own length, widened by slack; a rest of less than half a chunk belongs to none.
    """

    bands: tuple[tuple[int, float, float], ...] = ((64, 0.40, 1.25), (128, 0.40, 1.00), (256, 0.38, 0.88), (512, 0.36, 0.82), (1024, 0.33, 0.75), (4096, 0.30, 0.72), (16_384, 0.27, 0.70), (65_536, 0.24, 0.70))
    chunk: int = 2048
    slack: float = 0.02
    most_bad_percent: int = 25
    level: int = 3


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_low_chunks long, n_high_chunks long"


def _words(data: bytes) -> Iterator[list[bytes]]:
    """All words in lists of a few megabytes; cuts lie on blanks."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + PART) if len(data) - at > PART else None
        stop = cut.start() if cut else len(data)
        yield data[at:stop].split()
        at = stop


def _ranks(codes: np.ndarray) -> tuple[np.ndarray, int]:
    found, at = np.unique(codes, return_inverse=True)
    return at, len(found)


def repeated_words(data: bytes, width: int = WINDOW) -> tuple[int, int]:
    """(words, words inside a window of width words that occurs twice or more). Windows are told apart exactly."""
    known: dict[bytes, int] = {}
    parts = []
    for words in _words(data):
        for w in dict.fromkeys(words):
            known.setdefault(w, len(known))
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    n, base = len(ids), len(known) + 1
    if n <= width:
        return n, 0
    codes, kinds = ids[: n - width + 1], base
    for i in range(1, width):
        # Codes become ranks before their products could pass 62 bits.
        if kinds > (1 << 62) // base:
            codes, kinds = _ranks(codes)
        codes, kinds = codes * base + ids[i : n - width + 1 + i], kinds * base
    at, kinds = _ranks(codes)
    again = np.bincount(at, minlength=kinds)[at] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[: len(again)] += again
    edges[width : width + len(again)] -= again
    return n, int((np.cumsum(edges)[:n] > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def _side(size: int, ratio: float, limits: Limits, slack: float = 0.0) -> int:
    """-1 for a repetitive, 1 for an incompressible text of so many bytes, else 0."""
    band = next((b for b in reversed(limits.bands) if size >= b[0]), None)
    if band is None:
        return 0
    return -1 if ratio < band[1] - slack else int(ratio > band[2] + slack)


def judge(data: bytes, limits: Limits = Limits(), packer: zstandard.ZstdCompressor | None = None) -> dict:
    """The fields of FIELDS for one text."""
    packer = packer or zstandard.ZstdCompressor(level=limits.level)
    n_words, n_repeat = repeated_words(data)
    codes = np.frombuffer(data, np.uint8)
    chars = int(np.count_nonzero((codes & 0xC0) != 0x80)) - (len(data) - len(data.translate(None, _BLANKS)))
    ratio = len(packer.compress(data)) / len(data) if data else 0.0
    sides = [_side(len(c), len(packer.compress(c)) / len(c), limits, limits.slack) for at in range(0, len(data), limits.chunk) if 2 * len(c := data[at : at + limits.chunk]) >= limits.chunk]
    low, high = sides.count(-1), sides.count(1)
    failed = n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEAT_PERCENT * n_words
    kept = not failed and _side(len(data), ratio, limits) == 0 and 100 * (low + high) <= limits.most_bad_percent * len(sides)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": len(data) - len(data.translate(None, SYMBOLS)), "n_dup_lines": repeated_lines(data), "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept, "ratio": ratio, "n_chunks": len(sides), "n_low_chunks": low, "n_high_chunks": high}


def rules_column(text: Column, limits: Limits = Limits()) -> Column:
    """A struct of FIELDS for each text."""

    @F.arrow_udf(f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    def ruled(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packer = zstandard.ZstdCompressor(level=limits.level)
        kind = pa.struct([(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (f.split() for f in FIELDS.split(", "))])
        for part in parts:
            done = [judge(t or b"", limits, packer) for piece in slices(pa.RecordBatch.from_arrays([part], names=["text"])) for t in piece["text"].cast(pa.binary()).to_pylist()]
            yield pa.array(done, kind)

    return ruled(text)


def apply_rules(docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and FIELDS, one row for each input row, by whole texts.

    kept is false where base_failed (fewer than 10 words, or more than a fifth of them in repeated 5-word windows), where
    the whole text's ratio leaves the band of its length, or where more than most_bad_percent of its chunks leave theirs.
    Null and empty texts have no words, so they fail; their ratio is 0. Texts shorter than the first band are held to
    the counts alone. Repeated rows are judged each, null ids stay, an empty table gives no rows; further columns of
    docs are ignored.
    """
    ruled = columns(docs, doc_id=doc_id, text=text).select("doc_id", rules_column(F.col("text"), limits).alias("r"))
    return ruled.select("doc_id", "r.*")
