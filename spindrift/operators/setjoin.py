"""Similar sets, without a row for each word of a set in a join.

The words of a set are dealt by hash over parts, as many as keep PART to 2 * PART words in each. Two sets as similar as
least are as similar in one of their parts at the least (their Jaccard similarity is a mean of the parts'), so a part's
words of all sets are compared by themselves. A prefix filter does that: words in one order, rare ones first. The first
word that two parts share lies so early in both that those from there on can be as many as they must share; parity maps
(a bit flipped by each word) then differ in no more bits than the parts may in words. Words stand as hashes, of which
equal ones only add candidates. A task has the first words and the maps of two shards of sets, never all words.

Candidates are then compared by their words, in tiles of two homes: a set goes once to each tile that it has a candidate
in, and not to each candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least words of a set in a part, and bits of a word's hash by which words are counted (they set the order alone).
PART, COUNTED = 64, 20
#: Sets of one shard; more are dealt over shards, and a task compares two. Pairs a task looks at at a time, and words.
SHARD, AT_ONCE = 1 << 16, 1 << 18
#: Sets whose words a task deals at a time (10 bits of a key), and their words.
ROWS, WORDS = 1 << 10, 1 << 20
#: Homes of sets by the least hash of their words, which near copies share, and of those by their id.
KINDS, SPREAD = 16, 16
#: Bits by which texts that a pair may ask for are told.
SPOTS = 1 << 25


def level(n: np.ndarray) -> np.ndarray:
    """The power of two of parts that a set of n words has."""
    return np.floor(np.log2(np.maximum(n // PART, 1))).astype(np.int64)


def _least_size(n: np.ndarray, least: float) -> np.ndarray:
    return np.maximum(np.ceil(n * least - 1e-9), 1).astype(np.int64)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of n places each, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of items that hold most at most, or of one item; ends: what the items before each hold, and at last all."""
    begin, count = 0, len(ends) - 1
    while begin < count:
        end = min(count, max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, "right")) - 1))
        yield begin, end
        begin = end


def _maps(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each run of words a parity map of 256 bits, as four numbers."""
    bits = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
    flips = np.uint64(1) << (bits & np.uint64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(bits >> np.uint64(6) == w, flips, np.uint64(0)), first) for w in range(4)], axis=1)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """At most ROWS sets each, or so many that their words are at most WORDS."""
    ends = np.concatenate([[0], np.cumsum(batch["words"].value_lengths().to_numpy(zero_copy_only=False))])
    for begin, end in _runs(ends, WORDS):
        for at in range(begin, end, ROWS):
            yield batch.slice(at, min(ROWS, end - at))


def _dealer(counts: np.ndarray, shards: dict[tuple[str, int], int], least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    # Classes of counts, 2048 for each power of two: with the hash they order the words.
    classes = np.floor(np.log2(np.maximum(counts, 1)) * 2048).astype(np.uint16)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, place, side, id, only, home, size, n, marks) of sets (id, block, only, spread, words): a row a level, part and tile of shards; marks: map and first words."""
        for batch in (x for b in batches for x in _slices(b)):
            lists = batch["words"]
            words, size = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32).astype(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row, rank = np.repeat(np.arange(len(size), dtype=np.uint64), size), classes[words >> np.uint64(32 - COUNTED)].astype(np.uint64)
            low, top, spread, blocks = level(_least_size(size, least)), level(size), batch["spread"].to_numpy(zero_copy_only=False), batch["block"].to_pylist()
            home = np.minimum.reduceat(words, np.cumsum(size) - size).astype(np.int64) % KINDS * SPREAD + spread % SPREAD
            for at in range(int(low.min()), int(top.max()) + 1):
                held = ((low <= at) & (at <= top))[row.astype(np.int64)]
                if not held.any():
                    continue
                # Sorted by row, part, class and word, all in one number.
                part, ranked = words[held] & np.uint64((1 << at) - 1), min(16, 22 - at)
                keys = (row[held] << np.uint64(at) | part) << np.uint64(ranked) | rank[held] >> np.uint64(16 - ranked)
                keys = np.sort(keys << np.uint64(32) | words[held])
                place = (keys >> np.uint64(32 + ranked)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                n, of, part = np.diff(np.append(first, len(keys))), place[first] >> at, place[first] & ((1 << at) - 1)
                ordered = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                prefix = n - _least_size(n, least) + 1
                ends = np.cumsum(np.concatenate([[0], prefix + 8]))
                marks = np.empty(ends[-1], np.int32)
                marks[_ranges(ends[:-1], np.full(len(of), 8))] = _maps(ordered, first).view(np.int32).ravel()
                marks[_ranges(ends[:-1] + 8, prefix)] = ordered[_ranges(first, prefix)].view(np.int32)
                many = np.array([shards.get((b, at), 1) for b in blocks])[of]
                # A set meets its own shard and every other one, in a tile for each two shards.
                again, other = np.repeat(np.arange(len(of)), many), _ranges(np.zeros(len(of), np.int64), many)
                shard = (spread[of] // SPREAD % many)[again]
                tile = np.minimum(shard, other) * 4096 + np.maximum(shard, other)
                took, copied = pa.array(of[again]), pa.array(again)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["block"].take(took), pa.array((tile * 64 + at) << 32 | part[again]), pa.array((shard > other).astype(np.int8)), batch["id"].take(took), batch["only"].take(took),
                        pa.array(home[of[again]].astype(np.int32)), pa.array(size[of[again]].astype(np.int32)), pa.array(n[again].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(marks)).take(copied),
                    ],
                    names=["block", "place", "side", "id", "only", "home", "size", "n", "marks"],
                )

    return deal


def alike(n: np.ndarray, starts: np.ndarray, words: np.ndarray, maps: np.ndarray, side: np.ndarray, across: bool, mine: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of sets that may be similar in a part, each pair once, one of them at least of mine, and of different sides if across.

    Sets are in ascending order of n, their words in the part; starts and words hold the first of those in order of their rank.
    """
    count, prefix, most = len(n), np.diff(starts), int(n[-1])
    share = least / (1 + least)
    need = np.ceil(np.arange(2 * most + 1) * share - 1e-9).astype(np.int32)  # by the words of two parts, what they must share
    up_to, halves = np.searchsorted(n, np.arange(most + 1), "right"), [maps[:, w].copy() for w in (0, 1)]
    rows, places = count.bit_length(), int(prefix.max()).bit_length()
    # A word of a set in one number: word, side, set, place in the set.
    keys = words.view(np.uint32).astype(np.int64)
    for bits, low in ((1, side), (rows, np.arange(count))):
        keys <<= bits
        keys |= np.repeat(low, prefix)
    keys <<= places
    keys |= _ranges(np.zeros(count, np.int64), prefix)
    keys.sort()
    for begin, end in _runs(starts, AT_ONCE):
        row, place = np.repeat(np.arange(begin, end), prefix[begin:end]), _ranges(np.zeros(end - begin, np.int64), prefix[begin:end])
        # What is still to come of the smaller from its word on bounds the larger's size.
        largest = np.floor((n[row] - place) / share - n[row] + 1e-6).astype(np.int64)
        furthest = up_to[np.clip(largest, 0, most)] - 1
        worth = np.flatnonzero(furthest > row)
        row, furthest, word = row[worth], furthest[worth], words[starts[begin] + worth].view(np.uint32).astype(np.int64)
        held = (word << 1 | (side[row] ^ across)) << rows
        order, low, high = np.argsort(held), np.empty(len(row), np.int64), np.empty(len(row), np.int64)  # found in order, as that is faster
        low[order] = np.searchsorted(keys, ((held | row + 1) << places)[order])
        high[order] = np.searchsorted(keys, ((held | furthest + 1) << places)[order])
        partners = high - low
        # A set's words are looked up together, so that its pairs come once.
        first = np.searchsorted(row, np.arange(begin, end + 1))
        for some, until in _runs(np.concatenate([[0], np.cumsum(partners)])[first], AT_ONCE):
            own = slice(first[some], first[until])
            found = keys[_ranges(low[own], partners[own])]
            i, j = np.repeat(row[own], partners[own]), found >> places & (1 << rows) - 1
            both = n[i] + n[j]
            shared = need[both]
            could = np.flatnonzero((n[j] - (found & (1 << places) - 1) >= shared) & (mine[i] | mine[j]))
            i, j = i[could], j[could]
            # Half of the map tells most apart; near ones, found by many words, then go on once.
            near = sum(np.bitwise_count(half[i] ^ half[j]) for half in halves) <= (both - 2 * shared)[could]
            codes = np.sort(i[near] * count + j[near])
            i, j = np.divmod(codes[np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]], count)
            both = n[i] + n[j]
            near = np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1) <= both - 2 * need[both]
            if near.any():
                yield i[near], j[near]


def candidates(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, tile), a < b, each pair once: every pair of one block as similar as least, and some others. sets: id, block, only, words (hashes).

    Two sets whose only is equal and not null are no pair. tile says where the two are compared, by their homes.
    """
    ident = dict(sets.dtypes)["id"]
    tally = sets.select(F.explode("words").alias("w")).groupBy(F.shiftrightunsigned("w", 32 - COUNTED).alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 2 ** COUNTED rows
    counts = np.zeros(1 << COUNTED, np.int32)
    counts[tally["b"].to_numpy()] = np.minimum(tally["n"].to_numpy(), 2**31 - 1)
    n = F.size("words")
    levels = F.expr(f"sequence(cast(floor(log2(greatest(cast(greatest(ceil(size(words) * {least} - 1e-9), 1) AS long) div {PART}, 1))) AS int), cast(floor(log2(greatest(size(words) div {PART}, 1))) AS int))")
    many = sets.select("block", F.explode(levels).alias("level")).groupBy("block", "level").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD)
    shards = {(r["block"], r["level"]): -(-r["n"] // SHARD) for r in many.collect()}  # few: each stands for more than SHARD sets
    dealt = sets.where(n > 0).select("id", "block", "only", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("spread"), "words").mapInArrow(_dealer(counts, shards, least), f"block string, place long, side byte, id {ident}, only string, home int, size int, n int, marks array<int>")

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = key[1].as_py()
        at, tile = place >> 32 & 63, place >> 38
        held = pa.Table.from_batches(list(batches)).select(["side", "id", "only", "home", "size", "n", "marks"])
        held = held.take(pc.sort_indices(held["n"])).combine_chunks()
        lists = held["marks"].chunk(0)
        marks, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        starts, head = np.concatenate([[0], np.cumsum(lengths - 8)]), np.zeros(len(marks), bool)
        head[(np.cumsum(lengths) - lengths)[:, None] + np.arange(8)] = True
        maps, words = marks[head].view(np.uint64).reshape(-1, 4), marks[~head]
        only = held["only"].chunk(0).dictionary_encode().indices.fill_null(-1).to_numpy()
        size, home, ids = held["size"].to_numpy().astype(np.int64), held["home"].to_numpy().astype(np.int64), held["id"].chunk(0)
        n, side = held["n"].to_numpy().astype(np.int64), held["side"].to_numpy().astype(np.int64)
        del held, lists, marks, head
        for i, j in alike(n, starts, words, maps, side, tile >> 12 != tile & 4095, level(size) == at, least):
            keep = ((only[i] != only[j]) | (only[i] < 0)) & (np.minimum(size[i], size[j]) >= _least_size(np.maximum(size[i], size[j]), least))
            if keep.any():
                i, j = i[keep], j[keep]
                homes = np.minimum(home[i], home[j]) * (KINDS * SPREAD) + np.maximum(home[i], home[j])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(homes.astype(np.int32))], names=["x", "y", "tile"])

    found = dealt.groupBy("block", "place").applyInArrow(compare, f"x {ident}, y {ident}, tile int")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "tile").where("a <> b").distinct()


def _shared(codes: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, kinds: int) -> np.ndarray:
    """How many codes sets a and b share, by pair; a in ascending order. Codes of a set are distinct and below kinds."""
    out, size = np.empty(len(a), np.int64), np.diff(starts)
    first = np.append(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])), len(a))
    lines = max(1, 16 * AT_ONCE // kinds)  # sets with a line of marks each
    for low in range(0, len(first) - 1, lines):
        begin, end = first[low], first[min(low + lines, len(first) - 1)]
        own = a[first[low : min(low + lines, len(first) - 1)]]
        marked = np.zeros(len(own) * kinds, np.int8)
        marked[np.repeat(np.arange(len(own)) * kinds, size[own]) + codes[_ranges(starts[own], size[own])]] = 1
        line, b_size = np.searchsorted(own, a[begin:end]) * kinds, size[b[begin:end]]
        for some, until in _runs(np.concatenate([[0], np.cumsum(b_size)]), AT_ONCE):
            n, partners = b_size[some:until], b[begin + some : begin + until]
            said = marked[np.repeat(line[some:until], n) + codes[_ranges(starts[partners], n)]]
            out[begin + some : begin + until] = np.add.reduceat(said, np.cumsum(n) - n, dtype=np.int64)
    return out


def _asked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id, said) whose id is among ids, and few others: so texts that no pair asks for aren't shuffled."""
    spot = F.pmod(F.xxhash64("id"), F.lit(SPOTS))
    bits = ids.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS int))")).alias("bits")).toArrow()  # at most SPOTS / 64 rows
    held = np.zeros(SPOTS // 64, np.int64)
    held[bits["at"].to_numpy()] = bits["bits"].to_numpy()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["spot"].to_numpy()
            yield batch.filter(pa.array((held[at >> 6] >> (at & 63) & 1).astype(bool))).select(["id", "said"])

    return rows.withColumn("spot", spot).mapInArrow(keep, f"id {dict(rows.dtypes)['id']}, said string")


def similarities(rows: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of pairs (a, b, tile) whose words have a Jaccard similarity of least or more; rows: id, said (distinct words, a space between two)."""
    ident = dict(rows.dtypes)["id"]
    goes = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.col("tile").alias("to")).distinct()
    sent = _asked(rows.select("id", "said"), goes).join(goes, "id")

    def judge(held: pa.Table, asked: pa.Table) -> pa.Table:
        lists = pc.split_pattern(held["said"].combine_chunks(), " ")
        said = lists.flatten().dictionary_encode()
        codes, starts = said.indices.to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        a, b = (pc.index_in(asked[x], held["id"]).to_numpy().astype(np.int64) for x in "ab")
        order = np.argsort(a, kind="stable")
        a, b, size = a[order], b[order], np.diff(starts)
        shared = _shared(codes, starts, a, b, len(said.dictionary))
        similarity = shared / (size[a] + size[b] - shared)
        keep = similarity >= least
        took = pa.array(order[keep])
        return pa.table([asked["a"].take(took), asked["b"].take(took), pa.array(similarity[keep])], names=["a", "b", "similarity"])

    return sent.groupBy("to").cogroup(pairs.groupBy("tile")).applyInArrow(judge, f"a {ident}, b {ident}, similarity double")
