"""Line dedup: drop lines that many documents repeat, keeping the line of the largest document.

Native DataFrame operations only. Lines are exploded, reduced to a 128-bit hash of their key, and the distinct
documents of each hash are counted. The drop list is joined on the hash and a salt of the document, and holds a hash
once for each salt that has it, so a line found in a third of all documents is dealt over tasks. Positions to drop come
back to the documents, so texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import ascii_lower, columns

#: Parts that the documents of a line are dealt into.
SALTS = 32
#: Characters 0x20 and 0x09-0x0D, stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Columns doc_id, n_lines, n_dropped, kept_text; one row for each input row.

    Keys of at least min_chars code points held by at least min_docs documents lose all lines except those of the
    largest doc_id holding the key. Null or empty text: one empty line. Rows that repeat a doc_id are one document
    when documents are counted, and all of them keep or lose a line; null doc_ids together are one document, the
    smallest. An empty table gives no rows; further columns are ignored.
    """
    docs = columns(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), line_key), lambda k: F.length(k) >= min_chars))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    holders = docs.select("doc_id", F.explode(keys).alias("key")).select("doc_id", salt, *_hash(F.col("key"))).distinct()
    common = (
        holders.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_doc"), F.collect_set("salt").alias("salts"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "last_doc", F.explode("salts").alias("salt"))
    )
    lines = (
        docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", salt, *_hash(F.col("key")))
    )
    drops = (
        lines.join(common, ["h1", "h2", "salt"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
        .agg(F.collect_set("pos").alias("drop_pos"))
    )
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    split = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("drop_pos"))
    return (
        joined.select("doc_id", "text", "drop_pos", F.size(split).cast("long").alias("n_lines"))
        .withColumn("n_dropped", F.when(F.col("drop_pos").isNull(), 0).otherwise(F.size("drop_pos")).cast("long"))
        .withColumn("kept_text", F.when(F.col("drop_pos").isNull(), F.col("text")).otherwise(_pick(split, kept)))
        .select("doc_id", "n_lines", "n_dropped", "kept_text")
    )


def _pick(lines: Column, positions: Column) -> Column:
    """Lines at the positions, joined again in order."""
    held = F.array(F.struct(lines.alias("lines")))
    return F.array_join(F.transform(held, lambda x: F.array_join(F.transform(positions, lambda i: F.get(x["lines"], i)), "\n")), "")
