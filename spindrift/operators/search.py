"""Faceted filters, pages, facets and text search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import bound


def faceted(df: DataFrame, *, equals: dict[str, str] | None = None, contains: dict[str, str] | None = None, any_contains: tuple[list[str], str] | None = None, has_item: dict[str, str] | None = None, since: tuple[str, Column] | None = None, active: str | None = None, state: tuple[str, str] | None = None) -> DataFrame:
    """Filters that are given, all of them: equality and substrings without regard to case, items of arrays, recency, flags.

    state's column counts as needs_review where null. Only given predicates enter the plan, so they reach the scan.
    """
    for c, v in (equals or {}).items():
        df = df.where(F.lower(c) == v.lower())
    for c, v in (contains or {}).items():
        df = df.where(F.lower(c).contains(v.lower()))
    if any_contains:
        names, needle = any_contains
        hit = F.lit(False)
        for c in names:
            hit = hit | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
        df = df.where(hit)
    for c, v in (has_item or {}).items():
        df = df.where(F.array_contains(c, v))
    if since:
        df = df.where(F.col(since[0]) >= since[1])
    if active:
        df = df.where(F.col(active))
    if state:
        df = df.where(F.coalesce(state[0], F.lit("needs_review")) == state[1])
    return df


def page(df: DataFrame, order: list[Column], number: int, size: int = 50, most: int = 200) -> DataFrame:
    """One page; the order must end in a unique key. Sizes are held to 1..most."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n) for each facet in one pass: rows are expanded to a row a facet before one aggregate."""
    items = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    return df.select(F.explode(items).alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def conform(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """The given columns in order with type and default; missing ones take the default."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(default)).cast(kind).alias(c) for c, (kind, default) in columns.items()])


#: Weights of fields from most to least.
WEIGHTS = (1.0, 0.4, 0.2, 0.1)
#: Endings that words lose before they are compared, in order, and what takes their place.
ENDINGS = ((r"\b([a-z]{2,})ies\b", "y"), (r"\b([a-z]{2,}(?:ss|sh|ch|x))es\b", ""), (r"\b([a-z]{2,}[a-rt-z])s\b", ""), (r"\b([a-z]{3,})ing\b", ""), (r"\b([a-z]{3,})ed\b", ""))


def parse_search(text: str) -> list[list[tuple[bool, str]]]:
    """A web-style query as alternatives of (wanted, phrase): words are joined by and, 'or' separates, '-' excludes, quotes keep phrases."""
    out: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        term = (phrase or word).lower().strip()
        if not phrase and term == "or":
            out.append([])
        elif term:
            out[-1].append((not minus, term))
    return [group for group in out if group]


def stem_text(text: str) -> str:
    """The words of a query as they are compared."""
    text = re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()
    for ending, instead in ENDINGS:
        text = re.sub(ending, rf"\g<1>{instead}", text)
    return text


def stemmed(field: Column) -> Column:
    """A text's words as they are compared, one space before and behind each."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(field, F.lit(""))), r"[^a-z0-9]+", " "))
    for ending, instead in ENDINGS:
        words = F.regexp_replace(words, ending, f"$1{instead}")
    return F.concat(F.lit(" "), words, F.lit(" "))


def text_rank(fields: list[Column], query: str) -> Column:
    """(matches, rank): whether the fields together meet the query, and the weights of the fields its wanted words are in, summed.

    Words are compared without their endings, as whole words. Each field is cleaned once for all terms. A group of
    exclusions alone matches every row that holds none of them. The rank orders like weighted full-text search but
    isn't its number.
    """
    groups = parse_search(query)

    def judged(words: Column) -> Column:
        places = [F.get(words, i) for i in range(len(fields))]

        def anywhere(term: str) -> Column:
            hit = F.lit(False)
            for w in places:
                hit = hit | w.contains(f" {stem_text(term)} ")
            return hit

        matches, rank = F.lit(False), F.lit(0.0)
        for group in groups:
            all_of = F.lit(True)
            for wanted, term in group:
                all_of = all_of & (anywhere(term) if wanted else ~anywhere(term))
            matches = matches | all_of
        for term in sorted({t for g in groups for wanted, t in g if wanted}):
            for w, weight in zip(places, WEIGHTS, strict=False):
                rank = rank + F.when(w.contains(f" {stem_text(term)} "), weight).otherwise(0.0)
        return F.struct(matches.alias("matches"), rank.alias("rank"))

    return bound(F.array(*map(stemmed, fields)), judged)


def ranked(df: DataFrame, fields: list[Column], query: str) -> DataFrame:
    """The rows that meet the query, with their rank; judged in one pass, a row without a match has no rank."""
    judged = text_rank(fields, query)
    return df.withColumn("rank", bound(judged, lambda j: F.when(j["matches"], j["rank"]))).where(F.col("rank").isNotNull())
