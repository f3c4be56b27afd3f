"""A corpus pipeline over documents: quality, exact dedup, near-dedup, personal data, packing.

Each stage works on all that its predecessor kept, and all but the last return the columns of documents; further
columns of a stage's input are dropped. Any column may be null: a null text counts as empty, a null doc_id comes last
among ids (exact dedup: first), a null source packs under the empty name. Rows that repeat a doc_id with another text
are documents of their own; rows that repeat doc_id and text are copies, of which the dedup stages keep one. An empty
table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm import exact_dedup, minhash_dedup, packing, pii, quality
from spindrift.llm.common import ascii_lower, materialise, table
from spindrift.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, dropped: DataFrame, identity: Column) -> DataFrame:
    """docs without the rows of dropped (doc_id, identity), and of rows equal in both the first; one exchange serves both."""
    keys = ["_id", "_no_id", "_identity"]

    def keyed(df: DataFrame, identity: Column) -> DataFrame:
        return df.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_no_id": F.col("doc_id").isNull(), "_identity": identity})

    left = keyed(docs.select(COLUMNS), identity).join(keyed(dropped, F.col("identity")).select(keys), keys, "left_anti")
    once = F.row_number().over(Window.partitionBy(*keys).orderBy("lang", "source", "n_chars"))
    return left.withColumn("_n", once).where("_n = 1").select(COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores from 0.3 on; null and empty texts are scored like others, each row on its own."""
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return docs.select(COLUMNS).where(quality.score_column(F.col("text"), model) >= quality.LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z one row, that with the largest doc_id; null ids come first, a null text is an empty one."""
    dropped = exact_dedup.exact_groups(*exact_dedup.halves(docs)).where(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("identity"))
    return _without(docs, dropped, F.sha2(ascii_lower(F.col("text")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates one row, that with the least doc_id (null ids come last); texts without words stand alone."""
    dropped = minhash_dedup.near_classes(docs).where(~F.col("kept")).select("doc_id", F.col("text_hash").alias("identity"))
    return _without(docs, dropped, F.xxhash64("text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in brackets by kind, n_chars following where a text changed; all rows stay, null and empty texts as they are."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(COLUMNS).withColumn("spans", pii.span_column(text))
    return found.withColumn("text", F.when(F.size("spans") > 0, pii.redact(text, F.col("spans"))).otherwise(F.col("text"))).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 1024 tokens in the corpus's own mixture of sources; every row is packed, a null or empty text as the end id alone."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, with_ids=False).drop("ids")


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("personal_data", redact), ("packing", pack)]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
