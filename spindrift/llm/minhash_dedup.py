"""Near-dedup by ProbMinHash: signatures, banding, and exact verification.

A document is its five-word shingles weighted by how often it holds them. Every shingle is a Poisson process whose
rate is its weight; arrivals fall on random registers, each register keeps the shingle that arrives first, and a
document is done once no process can arrive before its slowest register. Two registers agree with the probability
Jaccard similarity of the documents. Bands of registers give candidates; candidates are verified exactly.

Equal shingle multisets are one content from the start, named by its digest; contents are the vertices of all links.
Verification goes before connection, so unverified band hits never chain:

1. Each content is verified against the least content of each of its buckets (its pivot). This takes a text a pair of
   content and pivot, linear in a group of copies, and joins most of what belongs together.
2. Only buckets that still hold several components go on, gathered by their largest component (the hub), so that what
   meets in many bands is looked at once. Members outside the hub (strays) are compared with all members in pairs of
   blocks: first by signatures, then, for members of a pair that meets in a band and may be similar, by texts. Pairs of
   one component are skipped, and what leaves a task are links that join components, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import columns, materialise, slices
from spindrift.operators.components import components

WORDS = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 all bands miss with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Register agreement this far (five standard deviations) below the threshold rules a pair out before exact work.
SLACK = 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Members of a pivot's block, and of a block of signatures; two of the latter are compared in one task.
BLOCK, CODE_BLOCK = 256, 1024
#: Bytes of text that two blocks may have together; beyond that they are cut further.
BLOCK_BYTES = 8 << 20
#: Bytes of text hashed at a time.
SLICE = 1 << 20
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_PLACES = np.array([pow(0xD1342543DE82EF95, i, 1 << 64) for i in range(WORDS)], np.uint64)


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingle hashes in order, and how often it holds each.

    Words are what white space separates after lower-casing; a text of one to four words is one shingle.
    """
    joined = [" ".join((t or "").lower().split()).encode() for t in texts]
    out, at = [], 0
    while at < len(joined):
        end, size = at, 0
        while end < len(joined) and (end == at or size + len(joined[end]) < SLICE):
            size, end = size + len(joined[end]) + 1, end + 1
        out += _shingle_slice(joined[at:end])
        at = end
    return out


def _shingle_slice(joined: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    data = np.frombuffer(b"\n".join(joined) + b"\n", np.uint8)
    stops = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate([[0], stops[:-1] + 1])
    n = 1 << int(len(data)).bit_length()
    up, down = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters()[data] * up[: len(data)])])
    words = _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    spread = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for i in range(WORDS if len(spread) else 0):
        spread += words[i : len(words) - WORDS + 1 + i] * _PLACES[i]
    spread = _mix(spread)
    ends = np.searchsorted(stops, np.flatnonzero(data == 10)) + 1
    out, begin = [], 0
    for text, end in zip(joined, ends.tolist(), strict=True):
        if not text:
            h = np.zeros(0, np.uint64)
        elif end - begin < WORDS:
            h = _mix((words[begin:end] * _PLACES[: end - begin]).sum(keepdims=True) + np.uint64(end - begin))
        else:
            h = np.sort(spread[begin : end - WORDS + 1])
        begin = end
        if len(h) > 1 and (h[1:] == h[:-1]).any():
            h, counts = np.unique(h, return_counts=True)
        else:
            counts = np.ones(len(h), np.int64)
        out.append((h, counts))
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The winning shingle of each register, a row a document; documents without shingles have zeros."""
    n_docs = len(sets)
    doc = np.repeat(np.arange(n_docs), [len(h) for h, _ in sets])
    hashes = np.concatenate([h for h, _ in sets]) if n_docs else np.zeros(0, np.uint64)
    weight = np.concatenate([c for _, c in sets]).astype(float) if n_docs else np.zeros(0)
    best = np.full(n_docs * REGISTERS, np.inf)
    winner = np.zeros(n_docs * REGISTERS, np.uint64)
    time, arrival = np.zeros(len(hashes)), 0
    latest = np.full(n_docs, np.inf)
    while len(hashes):
        arrival += 1
        draw = _mix(hashes + np.uint64(arrival * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        alive = time < latest[doc]
        if not alive.all():
            hashes, doc, weight, time, draw = hashes[alive], doc[alive], weight[alive], time[alive], draw[alive]
        register = doc * REGISTERS + (_mix(draw + _C2) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(best, register, time)
        won = best[register] == time
        winner[register[won]] = hashes[won]
        if arrival < 4 or arrival % 4 == 0:
            busy = np.unique(doc)
            latest[busy] = best.reshape(n_docs, REGISTERS)[busy].max(axis=1)
    return winner.reshape(n_docs, REGISTERS)


def band_keys(winners: np.ndarray) -> np.ndarray:
    parts = winners.reshape(len(winners), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(winners), 1))
    for i in range(ROWS):
        key = _mix(key * np.uint64(0xD1342543DE82EF95) + parts[:, :, i])
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two weighted sets, from sums over elements in order of their weight ratio."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1].astype(float), b[1].astype(float)
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    x, y = wa[ia], wb[ib]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # Elements of equal ratio give the same maximum either way, so ties need no care.
    above = only_a + np.cumsum(x[::-1])[::-1]
    below = only_b + np.concatenate([[0.0], np.cumsum(y)[:-1]])
    return float((1.0 / (above / x + below / y)).sum())


def _similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    if len(a[0]) == a[1].sum() and len(b[0]) == b[1].sum():  # no shingle twice: plain Jaccard
        low, high = sorted((len(a[0]), len(b[0])))
        if low < SIMILARITY * high - 1e-9:
            return False
        shared = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return shared >= (SIMILARITY - 1e-12) * (low + high - shared)
    return probability_jaccard(a, b) >= SIMILARITY - 1e-12


def _lists(keys: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each row's shingles (null without any) and its band keys."""
    for part in (x for batch in batches for x in slices(batch, most=SLICE)):
        sets = shingles(part["text"].to_pylist())
        content = [hashlib.blake2b(h.tobytes() + c.astype("<u4").tobytes(), digest_size=16).digest() if len(h) else None for h, c in sets]
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_hash"], pa.array(content, pa.binary()), _lists(band_keys(signatures(sets)))], names=["doc_id", "text_hash", "content", "keys"])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents that meet others, with two bytes of each register's winner and the band keys."""
    for part in (x for batch in batches for x in slices(batch, most=SLICE)):
        winners = signatures(shingles(part["text"].to_pylist()))
        codes = pa.array([row.tobytes() for row in (winners & np.uint64(0xFFFF)).astype("<u2")], pa.binary())
        yield pa.RecordBatch.from_arrays([part["content"], part["text"], codes, _lists(band_keys(winners))], names=["content", "text", "codes", "keys"])


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _against_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (is_member, content, text), each pivot before its members: links of members to their pivot."""
    pivot, name = None, None
    for part in (x for batch in batches for x in slices(batch, most=SLICE)):
        found = []
        for member, content, of in zip(part["is_member"].to_pylist(), part["content"].to_pylist(), shingles(part["text"].to_pylist()), strict=True):
            if not member:
                pivot, name = of, content
            elif _similar(pivot, of):
                found.append((name, content))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], schema=_LINKS)


GROUP = ["hub", "i", "j"]
#: side 0: a stray; 1: a member of the hub; 2: another member.
_SURVIVORS = pa.schema([("hub", pa.binary()), ("i", pa.int64()), ("j", pa.int64()), ("side", pa.int32()), ("component", pa.binary()), ("content", pa.binary())])


def _groups(batches: Iterator[pa.RecordBatch], sized: str) -> Iterator[list[tuple]]:
    """Runs of rows of one group, each row as a tuple in the order of the columns; rows come sorted by group."""
    key, rows = None, []
    for part in (x for batch in batches for x in slices(batch, sized, SLICE)):
        for row in zip(*part.to_pydict().values(), strict=True):
            if row[:3] != key:
                if len(rows) > 1:
                    yield rows
                key, rows = row[:3], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _candidates(rows: list[tuple], codes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strays, members, agreement) of the pairs of a group that meet in a band, may be similar, and are of two components."""
    side = np.array([r[3] for r in rows])
    names = {c: k for k, c in enumerate(sorted({r[4] for r in rows}))}
    component, order = np.array([names[r[4]] for r in rows]), np.argsort(np.argsort(np.array([r[5] for r in rows], object), kind="stable"), kind="stable")
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
    # Two strays meet twice, once as stray and member and once the other way round.
    wanted = (component[x][:, None] != component[y][None, :]) & ((side[y] == 1)[None, :] | (order[x][:, None] < order[y][None, :]))
    met = np.zeros(wanted.shape, bool)
    for t in range(BANDS):
        met |= keys[x, t][:, None] == keys[y, t][None, :]
    a, b = np.nonzero(wanted & met)
    agree = np.zeros(len(a), np.int64)
    for i in range(REGISTERS):
        agree += codes[x[a], i] == codes[y[b], i]
    near = agree >= (SIMILARITY - SLACK) * REGISTERS
    return x[a[near]], y[b[near]], agree[near]


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, side, component, content, codes, keys): those that are in a candidate pair, without codes and keys."""
    for rows in _groups(batches, "codes"):
        x, y, _ = _candidates(rows, np.stack([np.frombuffer(r[6], "<u2") for r in rows]), np.array([r[7] for r in rows]))
        stay = [rows[k][:6] for k in np.unique(np.concatenate([x, y])).tolist()]
        if stay:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stay, strict=True), _SURVIVORS, strict=True)], schema=_SURVIVORS)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, side, component, content, codes, keys, text): links that join components of a group."""
    for rows in _groups(batches, "text"):
        x, y, agree = _candidates(rows, np.stack([np.frombuffer(r[6], "<u2") for r in rows]), np.array([r[7] for r in rows]))
        sets = shingles([r[8] for r in rows])
        up, found = {r[4]: r[4] for r in rows}, []

        def root(c: bytes, up: dict = up) -> bytes:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        order = np.argsort(-agree, kind="stable")
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            a, b = root(rows[i][4]), root(rows[j][4])
            if a != b and _similar(sets[i], sets[j]):
                up[a] = b
                found.append((rows[i][5], rows[j][5]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], schema=_LINKS)


def _dealt(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)


def _links(met: DataFrame, texts: DataFrame, block: int, code_block: int) -> DataFrame:
    """Verified links (a, b) between contents from their buckets (band, key, content, pivot, n)."""
    # Members of a pivot whose buckets differ in size lie in different blocks; each block has the pivot's text.
    pairs = met.where("content <> pivot").groupBy("pivot", "content").agg(F.ceil(F.max("n") / block).cast("int").alias("blocks"))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
    heads = pairs.select("pivot", "blocks", "block").distinct().withColumn("content", F.col("pivot"))
    rows = pairs.withColumn("is_member", F.lit(True)).unionByName(heads.withColumn("is_member", F.lit(False)))
    rows = rows.join(texts.select("content", "text"), "content").select("pivot", "blocks", "block", "is_member", "content", "text")
    first = materialise(_dealt(rows, ["pivot", "blocks", "block"], "is_member").mapInArrow(_against_pivots, "a binary, b binary"), "pivot-links")

    joined = components(first).withColumnRenamed("vertex", "content")
    labelled = materialise(met.select("band", "key", "content").join(joined, "content", "left").withColumn("component", F.coalesce("component", "content")), "labelled")
    shares = labelled.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = shares.groupBy("band", "key").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("component", F.struct("n", "component")).alias("largest")).where("kinds > 1")
    members = labelled.join(mixed.select("band", "key", F.col("largest").alias("hub")), ["band", "key"]).select("hub", "component", "content").distinct()
    members = materialise(members.withColumn("stray", F.col("component") != F.col("hub")), "members")
    sizes = members.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / code_block).cast("int").alias("rows"), F.ceil(F.count_if("stray") / code_block).cast("int").alias("strays"))
    members = members.join(sizes, "hub")

    def dealt(blocks: str) -> Column:
        return F.pmod(F.xxhash64("content"), F.col(blocks)).cast("int")

    def each(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    strays = members.where("stray").select("hub", dealt("strays").alias("i"), each("rows").alias("j"), F.lit(0).alias("side"), "component", "content")
    others = members.select("hub", each("strays").alias("i"), dealt("rows").alias("j"), F.when(F.col("stray"), 2).otherwise(1).alias("side"), "component", "content")
    rows = strays.unionByName(others).withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")}).join(texts.select("content", "codes", "keys"), "content").select(*GROUP, "side", "component", "content", "codes", "keys")
    survivors = materialise(_dealt(rows, GROUP).mapInArrow(_screen, "hub binary, i long, j long, side int, component binary, content binary"), "survivors")
    weighed = survivors.join(texts, "content")
    weights = weighed.groupBy(*GROUP).agg(F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES).cast("int").alias("parts"))
    # A group of more bytes is parts x parts groups, strays dealt one way and members the other.
    cut = weighed.join(weights, GROUP).withColumn("own", F.pmod(F.xxhash64("content", F.lit(1)), F.col("parts")).cast("int")).withColumn("other", each("parts"))
    is_stray = F.col("side") == 0
    rows = cut.select("hub", (F.col("i") * 65536 + F.when(is_stray, F.col("own")).otherwise(F.col("other"))).alias("i"), (F.col("j") * 65536 + F.when(is_stray, F.col("other")).otherwise(F.col("own"))).alias("j"), "side", "component", "content", "codes", "keys", "text")
    return first.unionByName(_dealt(rows, GROUP).mapInArrow(_across, "a binary, b binary"))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, code_block: int = CODE_BLOCK) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), kept, text_hash; one row a row.

    Two documents are linked from a probability Jaccard similarity of 0.8 on, classes are what links connect. Null,
    empty and blank texts have no shingles and stand alone. Of a class the rows of one text and doc_id stay, those of
    the least doc_id, and of its texts the least by hash (text_hash tells rows of one doc_id apart). Null doc_ids
    come last; a class of null doc_ids alone has a null class_id. An empty table gives no rows, further columns are
    ignored.
    """
    docs = columns(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    signed = materialise(docs.mapInArrow(_sign, "doc_id long, text_hash long, content binary, keys array<long>"), "signatures")
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    reps = materialise(signed.where(F.col("content").isNotNull()).groupBy("content").agg(F.min(name).alias("best"), F.first("keys").alias("keys")), "contents")
    placed = reps.select("content", F.posexplode("keys").alias("band", "key"))
    crowded = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("pivot")).where("n > 1")
    met = materialise(placed.join(crowded, ["band", "key"]).select("band", "key", "content", "pivot", "n"), "buckets")

    wanted = met.select("content").distinct().join(reps.select("content", "best"), "content")
    wanted = wanted.select("content", F.coalesce("best.doc_id", F.lit(0)).alias("id"), F.col("best.no_id").alias("no_id"), F.col("best.text_hash").alias("text_hash"))
    sides = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_hash", "text").where(F.col("text").isNotNull())
    # Merged at every size: a broadcast that only small inputs get would hide what the join costs.
    held = sides.join(wanted.hint("merge"), ["id", "no_id", "text_hash"]).select("content", "text")
    once = F.row_number().over(Window.partitionBy("content").orderBy(F.lit(0)))
    texts = materialise(held.withColumn("_n", once).where("_n = 1").select("content", "text").mapInArrow(_coded, "content binary, text string, codes binary, keys array<long>"), "texts")

    linked = components(_links(met, texts, block, code_block)).join(reps.select(F.col("content").alias("vertex"), "best"), "vertex")
    linked = materialise(linked.select(F.col("vertex").alias("content"), "component", "best"), "linked")
    firsts = linked.groupBy("component").agg(F.min("best").alias("class"))
    classes = linked.select("content", "component").join(firsts, "component").select("content", "class")
    of_content = reps.select("content", "best").join(classes, "content", "left").select("content", F.coalesce("class", "best").alias("class"))
    found = signed.select("doc_id", "text_hash", "content").join(of_content, "content", "left")
    stays = F.col("content").isNull() | (F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("text_hash") == F.col("class.text_hash")))
    return found.select("doc_id", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("class.doc_id")).alias("class_id"), stays.alias("kept"), "text_hash")
