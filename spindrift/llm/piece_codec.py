"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of the model holds a whitespace marker after another character, so no merge reaches over a marker and a
text's ids are the ids of its marked words in order. A task segments each distinct marked word once (a bounded table)
and joins ids back by position; encoding needs no shuffle, and no vocabulary is collected anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import columns

MARK = "▁"
#: Words a table holds before it starts anew; bounds a task's memory and changes no result.
TABLE_WORDS = 500_000
#: Rows and ids of a batch that goes back to Spark.
OUT_ROWS = 512
_RUNS = re.compile(r" +[^ ]*").findall
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


class PieceEncoder(dict):
    """A table from a word to its packed ids when one marker stands before it."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        #: The table stands only where pieces can't cross markers, a marker is put first and spaces are left alone.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.encode("a  b ", out_type=str)[0].startswith(MARK) and self.model.decode(self.model.encode("a  b ")) == "a  b "
        self.lone = len(self.model.encode("a"))

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.model.encode(word), "<i4").tobytes()
        if len(self) >= TABLE_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def _run(self, run: str) -> bytes:
        """Spaces and the word behind them."""
        if run.isspace() and not run.strip(" "):
            return np.array(self.model.encode("a" + run)[self.lone :], "<i4").tobytes()
        return self[run[1:]]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if MARK in text or not self.by_word:
            return np.array(self.model.encode(text), "<i4").tobytes()
        if "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join(map(self._run, _RUNS(" " + text)))
        return b"".join(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker."""
    return PieceEncoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                packed = [enc.encode(t or "") for t in batch["text"].to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), ids], schema=_IDS)

    return run


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int, no begin or end ids) of each whole text; one row a row.

    Null and empty texts have no ids; repeated rows and null doc_ids are rows like others; further columns are ignored.
    """
    docs = columns(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_encode(model), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path).model
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                rows = [x if x is not None else [] for x in batch["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(map(model.decode, rows), pa.string())], names=["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, and text as the library decodes the ids; null or no ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, ids array<int>, text string")
