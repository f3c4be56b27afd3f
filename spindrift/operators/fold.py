"""State machines folded over a key's rows in order, without holding a key in one task.

Rows are sorted into ranges of (key, order), so a hot key spans many. Every range is folded at once, as if no key
reached over from the range before; then only the heads of ranges whose key did are folded again, from the state in
which the range before ended, until no assumed state differs from the one it stands for. A machine that forgets (a
breaker knows its last outcomes) settles in two or three rounds; one that never does takes a round a range of its key.
Between ranges one bounded state passes through the driver; rows never do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.scratch import materialise

Step = Callable[[list, dict], tuple[list, dict]]


def _folder(step: Step, start: list, inputs: list[str], carried: list[str], schema: pa.Schema, incoming: dict[int, list]):
    """mapInArrow over sorted ranges: each row's outputs, and after each range a row that holds its first and last key and the state it ends in."""
    outputs = [f for f in schema.names if f not in ("_part", "_key", "_range", *carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key = first = state = None

        def ending() -> pa.RecordBatch:
            row = {"_part": part, "_key": None, "_range": json.dumps([first, key, state])}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            made = {f: [] for f in outputs}
            parts, keys = batch["_part"].to_pylist(), batch["_key"].to_pylist()
            values = [batch[c].to_pylist() for c in inputs]
            begun = 0
            for i, (p, k) in enumerate(zip(parts, keys, strict=True)):
                if p != part:
                    if part is not None:
                        if i > begun:
                            yield _made(batch, begun, i, made, carried, schema)
                            made, begun = {f: [] for f in outputs}, i
                        yield ending()
                    part, first, key, state = p, k, k, incoming.get(p, start)
                elif k != key:
                    key, state = k, start
                state, out = step(state, {c: v[i] for c, v in zip(inputs, values, strict=True)})
                for f in outputs:
                    made[f].append(out[f])
            if batch.num_rows > begun:
                yield _made(batch, begun, batch.num_rows, made, carried, schema)
        if part is not None:
            yield ending()

    return run


def _made(batch: pa.RecordBatch, begun: int, ended: int, made: dict[str, list], carried: list[str], schema: pa.Schema) -> pa.RecordBatch:
    kept = batch.slice(begun, ended - begun)
    columns = {c: kept[c] for c in ("_part", "_key", *carried)} | {"_range": pa.nulls(ended - begun, pa.string())} | {f: pa.array(v, schema.field(f).type) for f, v in made.items()}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def fold(rows: DataFrame, key: list[str], order: list[str], inputs: list[str], step: Step, start: list, outputs: str) -> DataFrame:
    """key, order and outputs of every row: step(state, inputs as a dict) gives the next state and the row's outputs as a dict.

    order must be unique within a key. States are lists that JSON can hold, small ones: one for each range passes
    through the driver. Null keys are a key, an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    carried = [*key, *order]
    wanted = rows.select(*[F.col(c) for c in dict.fromkeys([*carried, *inputs])], F.to_json(F.struct(*key), {"ignoreNullFields": "false"}).alias("_key"))
    ranges = wanted.repartitionByRange("_key", *order).withColumn("_part", F.spark_partition_id())
    ranges = materialise(ranges, "fold-ranges")
    fields = {f.name: f for f in ranges.schema}
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_key", T.StringType()), T.StructField("_range", T.StringType()), *[fields[c] for c in carried], *T.StructType.fromDDL(outputs)])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])

    def folded(some: DataFrame, incoming: dict[int, list], name: str) -> tuple[DataFrame, dict[int, tuple]]:
        run = _folder(step, start, inputs, carried, to_arrow_schema(schema), incoming)
        done = materialise(some.repartition("_part").sortWithinPartitions("_part", "_key", *order).mapInArrow(run, schema), name)
        ends = {r["_part"]: tuple(json.loads(r["_range"])) for r in done.where("_range IS NOT NULL").select("_part", "_range").toLocalIterator()}
        return done.where("_range IS NULL").drop("_range"), ends

    done, ends = folded(ranges, {}, "fold-0")
    assumed, held, heads = dict.fromkeys(ends, start), [(done, None)], {}
    while True:
        todo = {}
        for before, part in zip(sorted(ends), sorted(ends)[1:], strict=False):
            state = ends[before][2] if ends[before][1] == ends[part][0] else start
            if state != assumed[part]:
                todo[part] = state
        if not todo:
            break
        wanted_heads = spark.createDataFrame([(p, ends[p][0]) for p in todo], "_part int, _key string")  # a row a range
        again, found = folded(ranges.join(F.broadcast(wanted_heads), ["_part", "_key"], "left_semi"), todo, f"fold-{len(held)}")
        for p, (first, _, state) in found.items():
            if ends[p][1] == first:
                ends[p] = (first, first, state)
        assumed |= todo
        heads |= dict.fromkeys(todo, len(held))
        held.append((again, len(held)))
    if heads:
        last = spark.createDataFrame([(p, ends[p][0], n) for p, n in heads.items()], "_part int, _key string, _round int")
        kept = [done.join(F.broadcast(last), ["_part", "_key"], "left_anti")]
        kept += [again.join(F.broadcast(last.where(F.col("_round") == n)), ["_part", "_key"], "left_semi") for again, n in held[1:]]
        done = kept[0]
        for k in kept[1:]:
            done = done.unionByName(k)
    return done.drop("_part", "_key")


#: Fixed values of the batch breaker: failures in a row, outcomes looked at, fewest of them, share that trips, rows left out.
IN_A_ROW, WINDOW, LEAST, SHARE, COOLDOWN = 15, 50, 20, 0.3, 50


def breaker(state: list, row: dict) -> tuple[list, dict]:
    """One visit of a platform: state is (failures in a row, last outcomes as text, visits still to skip or None while closed).

    An open breaker skips the next COOLDOWN visits, then lets visits through (half open) until a success comes while
    the share of failures is below SHARE. A skipped visit has no outcome.
    """
    streak, recent, left = state
    if left:
        return [streak, recent, left - 1], {"visited": False, "status": "open" if left > 1 else "half_open"}
    failed = bool(row["failed"])
    streak, recent = streak + 1 if failed else 0, (recent + "01"[failed])[-WINDOW:]
    share = recent.count("1") / len(recent) if len(recent) >= LEAST else 0.0
    if failed and left is None and (streak >= IN_A_ROW or share >= SHARE):
        left = COOLDOWN
    elif not failed and share < SHARE:
        left = None
    return [streak, recent, left], {"visited": True, "status": "closed" if left is None else "open" if left else "half_open"}


def breakers(visits: DataFrame, key: list[str], order: list[str], failed: str = "failed") -> DataFrame:
    """visited and status (after it) of every planned visit, by key in order; a null outcome is no failure."""
    return fold(visits.withColumn("failed", F.coalesce(F.col(failed), F.lit(False))), key, order, ["failed"], breaker, [0, "", None], "visited boolean, status string")
