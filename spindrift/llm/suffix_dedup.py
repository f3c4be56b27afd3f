"""Suffix-array dedup: remove every byte that a string of 100 bytes covers which also starts earlier.

Anchors. Every window of 100 bytes holds the least 32-byte gram among its 69 grams, chosen by hash from its content
alone; equal windows choose equal anchors. An anchor that occurs once can be in no repeat, so only anchors that occur
again send their context (up to 68 bytes before, 100 from it on) to be sorted; repeats inside a shard of documents are
settled there and sent once.

Sorting. The suffixes at the occurrences of an anchor (and the prefixes before them, read backwards) are put in order
as deep-shallow sorting does: multikey quicksort, eight bytes a character and all groups at once, to a shallow depth
(groups of one leave it at once), then a blind trie orders each group that is still tied. The order and its common-prefix lengths give, for every split
of a window around the anchor, classes of equal windows; all but a class's first are repeats.

Flow. Anchors are hashed in one pass (a task sends an anchor of a shard once, so a passage in every document is a row a
shard), the repeated ones meet the texts again by shard, contexts meet by anchor, covered intervals return by shard to
the same exchange of texts. Anchors that too many contexts share are dealt further, by the hash of each window around
them; the windows of one hash are sorted in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import columns, slices

#: Bytes of a repeat, of an anchor's gram, and grams a window chooses from.
LENGTH = 100
GRAM = 32
CHOICE = LENGTH - GRAM + 1
#: Depth to which multikey quicksort sorts before blind tries take over.
SHALLOW = 64
#: Occurrences beyond which an anchor's windows are dealt over tasks by their own hash before they are sorted.
HOT = 20_000
#: Bytes of text of a shard, the unit that meets its repeated anchors in one task.
SHARD_BYTES = 8_000_000
#: Bytes hashed at a time.
SLICE = 1 << 20
_BASE = 0x5851F42D4C957F2D
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every 32-byte gram: widths doubled five times."""
    h = _letters()[data]
    factor, width = _BASE, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, 2 * width
    return _mix(h)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every window of that width, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = best(x[:-reach], x[reach:])
        reach *= 2
    return best(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts laid end to end; a text under 100 bytes has none."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = _grams(data)
    least = _sliding(full, CHOICE, np.minimum)
    # Windows that reach over a text's end choose nothing.
    crossing = np.zeros(len(least) + 1, np.int32)
    inner = ends[:-1]
    np.add.at(crossing, np.clip(inner - LENGTH + 1, 0, len(least)), 1)
    np.add.at(crossing, np.clip(inner, 0, len(least)), -1)
    least = np.where(np.cumsum(crossing[:-1]) > 0, np.uint64(0), least)
    padded = np.concatenate([np.zeros(CHOICE - 1, np.uint64), least, np.zeros(CHOICE - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, CHOICE, np.maximum)[: len(full)] == full)
    return chosen, full[chosen]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, bytes, starts, ends) of runs of texts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            size, end = size + len(texts[end]), end + 1
        lengths = np.array([len(t) for t in texts[at:end]], np.int64)
        ends = np.cumsum(lengths)
        yield at, np.frombuffer(b"".join(texts[at:end]), np.uint8), ends - lengths, ends
        at = end


_ANCHORS = pa.schema([("anchor", pa.int64()), ("shard", pa.int32()), ("n", pa.int64())])


def _list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor of a shard once a batch, with its number of occurrences."""
    for batch in batches:
        found: dict[int, list[np.ndarray]] = {}
        for part in slices(batch, "data", SLICE):
            shards = part["shard"].to_numpy()
            for first, data, starts, ends in _slices([t or b"" for t in part["data"].to_pylist()]):
                at, h = anchors(data, starts, ends)
                of = shards[first : first + len(ends)][np.searchsorted(ends, at, "right")]
                for s in np.unique(of).tolist():
                    found.setdefault(s, []).append(h[of == s])
        for s, parts in found.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), s, np.int32)), pa.array(n, pa.int64())], schema=_ANCHORS)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor: those of anchors that occur more than once, n as the total over shards."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch["anchor"].to_numpy()
        # The last anchor may go on in the next batch: its rows are held, a row a shard and batch of its texts.
        cut = int(np.searchsorted(h, h[-1], "left"))
        if held and (cut or held[-1]["anchor"][0] != batch["anchor"][0]):
            same = int(np.searchsorted(h, held[-1]["anchor"][0].as_py(), "right"))
            yield from _totals(pa.Table.from_batches([*held, batch.slice(0, same)]).combine_chunks())
            held = []
            if same < cut:
                yield from _totals(pa.Table.from_batches([batch.slice(same, cut - same)]))
        elif cut:
            yield from _totals(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield from _totals(pa.Table.from_batches(held).combine_chunks())


def _totals(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    h, n = table["anchor"].to_numpy(), table["n"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    total = np.repeat(np.add.reduceat(n, first), np.diff(np.concatenate([first, [len(h)]])))
    keep = total > 1
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(table["shard"].to_numpy()[keep]), pa.array(total[keep], pa.int64())], schema=_ANCHORS)


#: kind 0: a context, by anchor; 1: a window's first place in a shard, by its hash; 2: an interval that is settled.
CONTEXTS = "kind int, key long, key2 long, doc_id long, row long, shard int, pos long, before int, context binary"
_CONTEXTS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("key2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("shard", pa.int32()), ("pos", pa.int64()), ("before", pa.int32()), ("context", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cover(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Add an interval; one that touches the last is joined to it at once."""
    if spans and start <= spans[-1][1] and end >= spans[-1][0]:
        spans[-1] = (min(start, spans[-1][0]), max(end, spans[-1][1]))
    else:
        spans.append((start, end))


def _contexts(hot: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A shard's texts and repeated anchors: contexts to compare elsewhere, and what the shard settles itself."""
        out = []
        if left.num_rows and right.num_rows:
            wanted, totals = right["anchor"].to_numpy().view(np.uint64), right["n"].to_numpy()
            order = np.argsort(wanted)
            wanted, totals = wanted[order], totals[order]
            left = left.sort_by([("doc_id", "ascending"), ("row", "ascending")])
            ids, rows, shard = left["doc_id"].to_pylist(), left["row"].to_pylist(), left["shard"][0].as_py()
            texts = [t or b"" for t in left["data"].to_pylist()]
            known, windows, settled = set(), set(), {}
            looked_at = (-1, -1)
            for first, data, starts, ends in _slices(texts):
                at, h = anchors(data, starts, ends)
                spot = np.searchsorted(wanted, h)
                spot[spot == len(wanted)] = 0
                is_wanted = wanted[spot] == h
                raw = data.tobytes()
                doc = np.searchsorted(ends, at, "right")
                for p, key, d, total in zip(at[is_wanted].tolist(), h[is_wanted].view(np.int64).tolist(), doc[is_wanted].tolist(), totals[spot[is_wanted]].tolist(), strict=True):
                    i, begin, end = first + d, int(starts[d]), int(ends[d])
                    low, high = max(begin, p - CHOICE + 1), min(end, p + LENGTH)
                    if high - low < LENGTH or i and (ids[i], rows[i]) == (ids[i - 1], rows[i - 1]):
                        continue
                    context = raw[low:high]
                    if total > hot:
                        # Windows up to the last one of the anchor before have been looked at.
                        fresh = looked_at[1] + begin + 1 if looked_at[0] == i else low
                        stop = min(p, high - LENGTH)
                        looked_at = (i, stop - begin)
                        for s in range(max(low, fresh), stop + 1):
                            digest = hashlib.blake2b(raw[s : s + LENGTH], digest_size=16).digest()
                            if digest in windows:
                                _cover(settled.setdefault(i, []), s - begin, s - begin + LENGTH)
                            else:
                                windows.add(digest)
                                k = np.frombuffer(digest, "<i8").tolist()
                                out.append((1, k[0], k[1], ids[i], rows[i], shard, s - begin, 0, raw[s : s + LENGTH]))
                    elif (key, p - low, context) in known:
                        # An earlier equal context compares for this one: all its windows are repeats.
                        _cover(settled.setdefault(i, []), low - begin, high - begin)
                    else:
                        known.add((key, p - low, context))
                        out.append((0, key, 0, ids[i], rows[i], shard, p - begin, p - low, context))
            for i, spans in settled.items():
                for start, end in _merged(spans):
                    out.append((2, (rows[i] ^ (ids[i] or 0) * 0x9E3779B97F4A7C15 ^ start) % 2**62, 0, ids[i], rows[i], shard, start, end - start, None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CONTEXTS, strict=True)] if out else [pa.array([], f.type) for f in _CONTEXTS], schema=_CONTEXTS)

    return run


class BlindTrie:
    """Orders strings by branching bytes alone: a descent that doesn't look at skipped bytes, one comparison with the leaf it ends in, and an insertion at the depth where they differ."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    def insert(self, text: bytes, name: int) -> None:
        """Leaves are [text, names]; branches are (depth, {byte or -1 at the end: node})."""
        node = self.root
        if node is None:
            self.root = [text, [name]]
            return
        while type(node) is tuple:
            branch = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(branch) or next(iter(node[1].values()))
        other = node[0]
        if other == text:
            node[1].append(name)
            return
        depth = common_prefix(text, other)
        parent, node = None, self.root
        while type(node) is tuple and node[0] < depth:
            parent = (node, text[node[0]])
            node = node[1][text[node[0]]]
        mine, theirs = (x[depth] if depth < len(x) else -1 for x in (text, other))
        leaf = [text, [name]]
        if type(node) is tuple and node[0] == depth:
            node[1][mine] = leaf
            return
        split = (depth, {theirs: node, mine: leaf})
        if parent is None:
            self.root = split
        else:
            parent[0][1][parent[1]] = split

    def ordered(self) -> Iterator[tuple[int, int, list[int]]]:
        """(common prefix with the leaf before, length, names) of each distinct text, in order; -1 for the first."""
        stack, depth = [(self.root, -1)], -1
        while stack:
            node, shared = stack.pop()
            if type(node) is tuple:
                branches = sorted(node[1].items(), reverse=True)
                for i, (_, child) in enumerate(branches):
                    stack.append((child, shared if i == len(branches) - 1 else node[0]))
            else:
                yield shared, len(node[0]), node[1]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def multikey_quicksort(words: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, tied): rows of words in order within their groups (ascending numbers), and for each place where its run of equal rows starts.

    A step splits every group at once into rows below, at and above its pivot by the word at the group's depth; rows at
    the pivot go on to the next word, and groups of one row or without further words are done.
    """
    n, depth = len(groups), np.zeros(len(groups), np.int64)
    order, place = np.argsort(groups, kind="stable"), np.arange(n)
    start, size, active = np.zeros(n, np.int64), np.zeros(n, np.int64), place

    def runs(fresh: np.ndarray) -> None:
        start[active] = np.maximum.accumulate(np.where(fresh, active, 0))
        at = np.flatnonzero(fresh)
        size[active] = np.repeat(np.diff(np.append(at, len(fresh))), np.diff(np.append(at, len(fresh))))

    held = groups[order]
    if n:
        runs(np.concatenate([[True], held[1:] != held[:-1]]))
    active = active[size > 1]
    while len(active):
        rows, level, first = order[active], depth[active], start[active]
        word, pivot = words[rows, level], words[order[first + size[active] // 2], level]
        side = (word > pivot).astype(np.int64) - (word < pivot)
        key = first * 3 + side
        moved = np.argsort(key, kind="stable")
        order[active], key, side = rows[moved], key[moved], side[moved]
        depth[active] = level + (side == 0)
        runs(np.concatenate([[True], key[1:] != key[:-1]]))
        active = active[(size[active] > 1) & (depth[active] < words.shape[1])]
    return order, start


def deep_shallow(texts: list[bytes], groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): texts in order within their groups (ascending numbers), and each one's common prefix with the one before, -1 at a group's start."""
    n = len(texts)
    words = np.frombuffer(b"".join(t[:shallow].ljust(shallow, b"\0") for t in texts), ">u8").astype(np.uint64).reshape(n, shallow // 8)
    order, tied = multikey_quicksort(words, groups)
    out, shared = [], []
    bounds = [*np.flatnonzero(tied == np.arange(n)).tolist(), n]
    listed, of_group = order.tolist(), groups.tolist()
    for low, high in zip(bounds, bounds[1:], strict=False):
        head = listed[low]
        border = -1 if not out or of_group[out[-1]] != of_group[head] else None
        if high - low == 1:
            leaves = [(-1, 0, [head])]
        else:
            trie = BlindTrie()
            for i in listed[low:high]:
                trie.insert(texts[i], i)
            leaves = trie.ordered()
        for prefix, length, names in leaves:
            for k, i in enumerate(names):
                if k:
                    shared.append(length)
                elif prefix >= 0:
                    shared.append(prefix)
                else:
                    shared.append(-1 if border is not None else common_prefix(texts[out[-1]], texts[i]))
                out.append(i)
    return np.array(out, np.int64), np.array(shared, np.int64)


def _settle(groups: np.ndarray, contexts: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in order of (doc, position): the first and last window offset before the anchor at which each repeats an earlier one; -1 for none.

    Offset o means the window that starts o bytes before the anchor.
    """
    n = len(contexts)
    size = np.array([len(c) for c in contexts], np.int64)
    after = size - before
    right_order, right_shared = deep_shallow([c[b:] for c, b in zip(contexts, before.tolist(), strict=True)], groups)
    left_order, left_shared = deep_shallow([c[:b][::-1] for c, b in zip(contexts, before.tolist(), strict=True)], groups)
    most, least = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(CHOICE):
        fits = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        if len(fits) < 2:
            continue
        right[right_order] = np.cumsum(right_shared < LENGTH - o)
        left[left_order] = np.cumsum(left_shared < o)
        _, first = np.unique(right[fits] * (n + 1) + left[fits], return_index=True)
        again = np.ones(len(fits), bool)
        again[first] = False
        hit = fits[again]
        most[hit] = o
        least[hit] = np.where(least[hit] < 0, o, least[hit])
    return least, most


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (kind, key, key2, doc_id, row, pos): covered intervals."""

    def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        kind = table["kind"].to_numpy()
        ids, shards, pos, before = table["doc_id"], table["shard"], table["pos"].to_numpy(), table["before"].to_numpy()
        starts, ends = np.full(len(kind), -1, np.int64), np.full(len(kind), -1, np.int64)
        local = kind == 2
        starts[local], ends[local] = pos[local], pos[local] + before[local]
        keys = np.stack([table["key"].to_numpy(), table["key2"].to_numpy()], axis=1)
        windows = np.flatnonzero(kind == 1)
        if len(windows) > 1:
            group = np.cumsum(np.concatenate([[True], (keys[windows[1:]] != keys[windows[:-1]]).any(axis=1)]))
            windows, group = windows[np.bincount(group)[group] > 1], group[np.bincount(group)[group] > 1]
            order, shared = deep_shallow(table["context"].take(pa.array(windows)).to_pylist(), group)
            again = windows[order[shared >= LENGTH]]
            starts[again], ends[again] = pos[again], pos[again] + LENGTH
        held = np.flatnonzero(kind == 0)
        if len(held) > 1:
            key = keys[held, 0]
            group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
            shared = np.bincount(group)[group] > 1
            held, group = held[shared], group[shared]
            if len(held):
                least, most = _settle(group, table["context"].take(pa.array(held)).to_pylist(), before[held].astype(np.int64))
                hit = most >= 0
                starts[held[hit]], ends[held[hit]] = pos[held[hit]] - most[hit], pos[held[hit]] - least[hit] + LENGTH
        keep = pa.array(np.flatnonzero(ends >= 0))
        yield pa.RecordBatch.from_arrays([ids.take(keep).combine_chunks(), table["row"].take(keep).combine_chunks(), shards.take(keep).combine_chunks(), pa.array(starts[ends >= 0]), pa.array(ends[ends >= 0])], schema=_SPANS)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= 20_000:
            table = pa.Table.from_batches(held).combine_chunks()
            kind, key = table["kind"].to_numpy(), table["key"].to_numpy()
            same = (kind == kind[-1]) & (key == key[-1])
            cut = len(kind) if kind[-1] == 2 else int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            yield from settled(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield from settled(pa.Table.from_batches(held).combine_chunks())


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _remove(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """A shard's texts without the union of their intervals."""
    covered: dict[tuple, list[tuple[int, int]]] = {}
    for doc, row, _, start, end in zip(*spans.to_pydict().values(), strict=True):
        covered.setdefault((doc, row), []).append((start, end))
    out = []
    for doc, row, data in zip(texts["doc_id"].to_pylist(), texts["row"].to_pylist(), texts["data"].to_pylist(), strict=True):
        data = data or b""
        spans_here, kept, at = _merged(covered.get((doc, row), [])), [], 0
        for start, end in spans_here:
            kept.append(data[at:start])
            at = end
        kept.append(data[at:])
        out.append((doc, len(data), sum(e - s for s, e in spans_here), len(spans_here), b"".join(kept)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)] if out else [pa.array([], f.type) for f in _RESULT], schema=_RESULT)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes); one row a row.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a string of 100 bytes that covers it also starts
    earlier: in a smaller doc_id or earlier in the same document; all is judged on the input. Matches never cross
    documents. Rows that repeat a doc_id are ordered by a hash of their text, equal ones count as one text; null ids
    come last. Further columns are ignored.
    """
    rows = columns(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    # Shards are ranges of doc_id, so a task sends an anchor once for each of the few shards it reads.
    placed = rows.withColumn("row", F.xxhash64("data")).withColumn("shard", _shards(rows, shard_bytes))  # row tells rows of one id apart
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = placed.select("shard", "data").mapInArrow(_list_anchors, "anchor long, shard int, n long")
    repeated = listed.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_repeated, "anchor long, shard int, n long")
    compared = placed.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(_contexts(hot), CONTEXTS)
    spans = compared.repartition(parts, "kind", "key", "key2").sortWithinPartitions("kind", "key", "key2", F.col("doc_id").asc_nulls_last(), "row", "pos").mapInArrow(_spans_of, "doc_id long, row long, shard int, start long, end long")
    return placed.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(_remove, RESULT)


#: Equal ranges of ids whose sizes are collected to cut shards.
RANGES = 4096


def _shards(rows: DataFrame, shard_bytes: int) -> Column:
    """A shard number for each doc_id: neighbouring ranges of ids make up a shard, a crowded range is several by hash.

    Ranges lie between the percentiles 0.5 and 99.5 of the ids, in floating point: far-off ids fall into the first or
    last range and ids may span all 64 bits.
    """
    ends = rows.agg(F.percentile_approx("doc_id", [0.005, 0.995], 2000)).first()[0]
    if ends is None:
        return F.lit(0)
    low, span = float(ends[0]), max(1.0, float(ends[1]) - float(ends[0]))
    at = F.floor((F.col("doc_id").cast("double") - low) / span * RANGES)
    at = F.coalesce(F.greatest(F.lit(0), F.least(at, F.lit(RANGES - 1))), F.lit(RANGES - 1)).cast("int")
    weights = {r.at: r.weight for r in rows.groupBy(at.alias("at")).agg(F.sum(F.octet_length("data") + 64).alias("weight")).collect()}
    first, split, shard, filled = [], [], 0, 0
    for i in range(RANGES):
        weight = weights.get(i, 0)
        pieces = -(-weight // shard_bytes) if weight > shard_bytes else 1
        if filled and filled + weight > shard_bytes:
            shard, filled = shard + 1, 0
        first.append(shard)
        split.append(pieces)
        if pieces > 1:
            shard, filled = shard + pieces, 0
        else:
            filled += weight
    return (F.get(F.lit(first), at) + F.pmod(F.xxhash64("doc_id", "row"), F.get(F.lit(split), at))).cast("int")
