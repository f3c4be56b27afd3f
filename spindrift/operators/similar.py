"""Near-duplicate postings, similarity search, salary estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import tokens
from spindrift.operators.setjoin import candidates, similarities
from spindrift.scratch import materialise


def near_duplicates(df: DataFrame, ident: str, block: Column, source: str, text: str, least: float = 0.6) -> DataFrame:
    """(a, b, similarity) of rows of one block and different sources whose token sets have a Jaccard similarity of least or more."""
    return similar_sets(df.select(F.col(ident).alias("id"), block.alias("block"), F.col(source).alias("only"), tokens(F.col(text)).alias("tokens")).where(F.col("only").isNotNull()), least)


def similar_sets(sets: DataFrame, least: float = 0.6) -> DataFrame:
    """(a, b, similarity) of similar token sets of one block, from id, block, only and tokens; two sets whose only is equal and not null are no pair.

    Exact: candidates (setjoin.py) are all similar pairs and few others, found by hashes of tokens; the tokens themselves
    (without white space, one text a set) are read again only for sets that are in a candidate, once a tile, and compared.
    """
    kept = F.col("id"), F.col("block").cast("string").alias("block"), F.col("only").cast("string").alias("only")
    rows = materialise(sets.where(F.size("tokens") > 0).select(*kept, F.concat_ws(" ", "tokens").alias("said")), "token-sets")
    pairs = materialise(candidates(rows.select("id", "block", "only", F.transform(F.split("said", " "), lambda t: F.shiftright(F.xxhash64(t), 32).cast("int")).alias("words")), least), "candidates")
    return materialise(similarities(rows, pairs, least), "similarities")


def survivors(rows: DataFrame, clusters: DataFrame, ident: str, order: list[Column]) -> DataFrame:
    """Clustered rows with survives: the first of each cluster by the order."""
    joined = rows.join(clusters, F.col(ident) == F.col("vertex")).drop("vertex")
    return joined.withColumn("survives", F.row_number().over(Window.partitionBy("component").orderBy(*order)) == 1)


def dot(vector: Column, query: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.lit(query), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def top_similar(df: DataFrame, ident: str, vector: str, query: list[float], k: int, least: float | None = None) -> DataFrame:
    """The k rows most similar to a unit vector; similarity is rounded to 4 places after ordering and the threshold. An empty vector finds nothing."""
    scored = df.where(F.lit(bool(query))).select(ident, dot(F.col(vector), query or [0.0]).alias("_s"))
    if least is not None:
        scored = scored.where(F.col("_s") >= least)
    tier = F.when(F.col("_s") > 0.7, "excellent").when(F.col("_s") > 0.5, "good").otherwise("fair")
    return scored.orderBy(F.col("_s").desc(), ident).limit(k).select(ident, F.round("_s", 4).alias("similarity"), tier.alias("tier"))


def hashed_embedding(text: Column, dims: int = 384) -> Column:
    """A deterministic unit vector of a text's tokens, each adding a signed unit at a hashed place: a stand-in where no model is at hand."""
    spots = F.transform(tokens(text), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dims)).cast("int").alias("at"), F.when(F.pmod(F.xxhash64(F.lit(1), t), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(spots, lambda s: s["at"] == i), F.lit(0.0), lambda a, s: a + s["sign"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def back_off(df: DataFrame, levels: list[list[str]], value: str, least: int = 3, least_last: int = 2) -> DataFrame:
    """For each combination of the finest level's keys an estimate from the first level with enough rows.

    One grouping-sets aggregate gives every level; keys look their estimates up by joins. n is the level's rows, level
    its place; the last level needs least_last rows only.
    """
    finest = levels[0]
    stats = df.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in finest]).agg(F.grouping_id().alias("_g"), F.count(value).alias("n"), F.median(value).alias("mid"), F.stddev_samp(value).alias("sd"), F.avg(value).alias("mean"))
    out = df.select(*finest).distinct()
    found = []
    for i, level in enumerate(levels):
        code = sum(1 << (len(finest) - 1 - j) for j, c in enumerate(finest) if c not in level)
        part = stats.where(F.col("_g") == code).select(*level, F.struct("n", "mid", "sd", "mean").alias(f"_s{i}"))
        out = out.join(part, level, "left")
        need = least_last if i == len(levels) - 1 else least
        found.append(F.when(F.col(f"_s{i}.n") >= need, F.struct(F.lit(i).alias("level"), f"_s{i}.n", f"_s{i}.mid", f"_s{i}.sd", f"_s{i}.mean")))
    best = F.coalesce(*found)
    return out.select(*finest, best["level"].alias("level"), best["n"].alias("n"), best["mid"].alias("mid"), confidence(best["n"], best["sd"], best["mean"]).alias("confidence"))


def confidence(n: Column, sd: Column, mean: Column) -> Column:
    """Grows with the sample and falls with its spread, from five rows on."""
    base = F.least(F.lit(0.95), 0.4 + n / 100)
    return F.when(n >= 5, base * F.greatest(F.lit(0.5), 1 - sd / mean)).otherwise(base)


def fill_salaries(jobs: DataFrame, estimates: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Rows without a salary take the estimate (salary_min, salary_max, confidence by keys) if it is confident enough; salary_estimated tells."""
    e = estimates.select(*keys, F.col("salary_min").alias("_low"), F.col("salary_max").alias("_high"), "confidence")
    out = jobs.join(e, keys, "left")
    use = F.col("salary_min").isNull() & (F.col("confidence") >= least)
    out = out.withColumn("salary_estimated", F.coalesce(use, F.lit(False)))
    for c, v in (("salary_min", "_low"), ("salary_max", "_high")):
        out = out.withColumn(c, F.when(F.col("salary_estimated"), F.bround(F.col(v), -3)).otherwise(F.col(c)))
    return out.drop("_low", "_high", "confidence")
