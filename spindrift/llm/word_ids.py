"""Token ids by the tokenizers library, each distinct word segmented once a task.

Both vocabularies split a text into words before any merge, so a text's ids are its words' ids in order. Texts are cut
into chunks (a word with the marks around it) over whole arrays, and only a batch's distinct chunks are looked up: a
task keeps bounded tables from chunk and from word to packed ids, and asks the library's model for words it lacks.
Texts with characters outside the plain set below go to the library whole, so its Unicode rules never have to be
restated.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Letters that both vocabularies' patterns treat as letters and that normalisation leaves alone (but for case).
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The plain set in Latin-1: tab, line ends, printable ASCII and the letters above.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
#: Latin-1 in lower case.
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_IS_SPACE = np.isin(np.arange(256), [0, 9, 10, 13, 32])
#: What stands before a chunk: nothing at a text's start, or the mark that ended the chunk before.
_BEFORE = (b"", b" ", b"\n")
#: Entries of a table's young half and of its old one; bounds a task's memory and changes no result.
TABLE_ENTRIES = 250_000


def _byte_alphabet() -> list[str]:
    """Printable stand-ins for bytes: printable Latin-1 stands for itself, the rest follow from code point 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = sorted(set(range(256)) - own)
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class _Table:
    """A bounded table that fills itself by a function: when the young half is full it becomes the old one, and entries asked for again come back from there."""

    def __init__(self, make) -> None:
        self.make, self.young, self.old = make, {}, {}

    def __getitem__(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(self.young) >= TABLE_ENTRIES:
                self.young, self.old = {}, self.young
            self.young[key] = value
        return value


class WordEncoder:
    """encode(text) gives the library's ids (add_special_tokens=False) as packed little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.alphabet = _byte_alphabet()
        # The alternatives of the vocabulary's own pattern over the plain set; the first characters of letters and
        # digits exclude the others, so they may come first.
        if self.lower:
            pattern = rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}0-9]+"
        else:
            pattern = rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
        self.find_words = re.compile(pattern).findall
        self.words = _Table(self._word)
        self.chunks = _Table(self._chunk)

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isalpha() else "".join([self.alphabet[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("latin-1")
        if text.isalpha() or not self.lower and text[1:].isalpha() and text[0] == " ":
            return self._word(text)  # one word, which needs no search and no entry of its own
        return b"".join([self.words[w] for w in self.find_words(text)])

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has); null counts as empty."""
        plain, other = [], {}
        for i, text in enumerate(texts):
            try:
                raw = (text or "").encode("latin-1")
            except UnicodeEncodeError:
                raw = b"\0"
            if raw.translate(None, _PLAIN) or b"<|" in raw:
                other[i], raw = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"), b""
            plain.append(raw)
        ids, counts = self._plain_ids(plain)
        if not other:
            return ids, counts
        ends = np.cumsum(counts)
        parts = [other[i] if i in other else ids[end - n : end] for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode_ended(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with end_id behind each text's ids."""
        ids, counts = self.encode_all(texts)
        return np.insert(ids, np.cumsum(counts), end_id), counts + 1

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].tobytes()

    def _plain_ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain texts in Latin-1."""
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        joined = b"\0".join(texts) + b"\0"
        data = np.frombuffer(joined.translate(_LOWER) if self.lower else joined, np.uint8)
        cut = _IS_SPACE[data]
        if not self.lower:
            # A space or line end between two marks ends a word for certain and belongs to the one that follows.
            lone = ~cut[:-2] & ~cut[2:] & ((data[1:-1] == 32) | (data[1:-1] == 10))
            cut = data == 0
            cut[1:-1] |= lone
        at = np.flatnonzero(cut)
        offsets = np.concatenate([[0], at - np.arange(len(at))]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[~cut])]).dictionary_encode()
        mark = data[np.concatenate([at[-1:], at[:-1]])]
        before = np.where(mark == 32, 1, np.where(mark == 10, 2, 0)) if not self.lower else 0
        code = pieces.indices.to_numpy() * 3 + before
        used = np.zeros(3 * len(pieces.dictionary), bool)
        used[code] = True
        keys = np.flatnonzero(used)
        _, bounds, stored = pieces.dictionary.buffers()
        bounds, stored = np.frombuffer(bounds, np.int32)[: len(pieces.dictionary) + 1].tolist(), stored.to_pybytes() if stored else b""
        packed = [self.chunks[_BEFORE[k % 3] + stored[bounds[k // 3] : bounds[k // 3 + 1]]] for k in keys.tolist()]
        place = np.zeros(len(used), np.int64)
        place[keys] = np.arange(len(keys))
        sizes = np.array([len(p) // 4 for p in packed], np.int64)
        flat, starts = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(sizes) - sizes
        which = place[code]
        lengths = sizes[which]
        stops = np.cumsum(lengths)
        ids = flat[np.repeat(starts[which] - stops + lengths, lengths) + np.arange(stops[-1])]
        return ids, np.diff(stops[data[at] == 0], prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker."""
    return WordEncoder(path)
