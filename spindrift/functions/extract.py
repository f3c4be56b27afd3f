"""Signals read from free text: salary, experience, work mode, level, technologies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import vocabulary as V
from spindrift.functions.text import bound, unescape

SALARY = "struct<salary_min:double,salary_max:double,currency:string>"


def _plain(text: Column) -> Column:
    return bound(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", ""), unescape, "string")


def _amount(text: Column) -> Column:
    def number(digits: Column) -> Column:
        whole = F.replace(digits, F.lit("."), F.lit(""))
        return F.when(F.length(digits) - F.length(whole) > 1, whole).otherwise(digits).try_cast("double")

    return bound(F.replace(text, F.lit(","), F.lit("")), number, "double")


def _holds(lower: Column, words: tuple[str, ...]) -> Column:
    """A cheap test before a pattern: whether one of the words is in the text at all."""
    held = F.lit(not words)
    for w in words:
        held = held | lower.contains(w)
    return held


def _revenue(around: Column) -> Column:
    def judged(lower: Column) -> Column:
        near = F.lit(False)
        for p, words in zip(V.REVENUE, V.REVENUE_WORDS, strict=True):
            near = near | (_holds(lower, words) & around.rlike(f"(?i){p}"))
        return near

    return bound(F.lower(around), judged, "boolean")


def salary(text: Column) -> Column:
    """(salary_min, salary_max, currency) of the first pattern whose first match is a plausible salary, or null.

    A match near revenue figures, out of limits or upside down falls through to the next pattern. What several
    expressions use is bound, as each would work it out again.
    """
    none = F.lit(None).cast(SALARY)

    def around(plain: Column, found: Column) -> Column:
        return bound(F.instr(plain, found), lambda at: bound(F.greatest(at - 100, F.lit(1)), lambda first: F.substring(plain, first, at - first + F.length(found) + 100), "string"), "string")

    def judge(plain: Column, found: Column, pattern: str) -> Column:
        in_thousands = F.lower(found).contains("k")
        amounts = F.transform(F.array(*[F.regexp_extract(found, pattern, i) for i in (1, 2)]), lambda t: bound(_amount(t), lambda x: F.when(in_thousands & (x < 1000), x * 1000).otherwise(x), "double"))
        sign = F.when(found.contains("$"), "USD").when(found.contains("€"), "EUR").when(found.contains("£"), "GBP").otherwise("USD")

        def verdict(a: Column) -> Column:
            low, high = a[0], a[1]
            sound = (low >= V.SALARY_LIMITS[0]) & (high <= V.SALARY_LIMITS[1]) & (low <= high) & ~bound(around(plain, found), _revenue, "boolean")
            return F.when(sound, F.struct(F.floor(low).cast("double").alias("salary_min"), F.floor(high).cast("double").alias("salary_max"), sign.alias("currency"))).otherwise(none)

        return bound(amounts, verdict, SALARY)

    def attempt(plain: Column, pattern: str) -> Column:
        # No pattern matches an empty text, so nothing found is an empty one.
        return bound(F.regexp_extract(plain, pattern, 0), lambda found: F.when(found != "", judge(plain, found, pattern)), SALARY)

    def attempts(plain: Column) -> Column:
        return bound(F.lower(plain), lambda lower: F.coalesce(*[F.when(_holds(lower, words), attempt(plain, f"(?i){p}")) for p, words in zip(V.SALARIES, V.SALARY_WORDS, strict=True)]), SALARY)

    def whole(said: Column) -> Column:
        return F.when(said.rlike(r"[\$£€¥]|&#|&[a-z]+;"), bound(_plain(said), attempts, SALARY))

    return bound(text, whole, SALARY)


def salary_range(text: Column) -> Column:
    """(salary_min, salary_max, currency) of a short salary string; one value is both."""
    clean = F.replace(F.trim(F.regexp_replace(text, r"[\$£€¥]", "")), F.lit(","), F.lit(""))
    span = r"(\d+(?:\.\d+)?)\s*(?:k|K)?\s*[-–—]\s*(\d+(?:\.\d+)?)\s*(?:k|K)?"
    single = F.nullif(F.regexp_extract(clean, r"(\d+(?:\.\d+)?)", 1), F.lit(""))
    low = F.coalesce(F.nullif(F.regexp_extract(clean, span, 1), F.lit("")), single).try_cast("double")
    high = F.coalesce(F.nullif(F.regexp_extract(clean, span, 2), F.lit("")), single).try_cast("double")
    in_thousands = F.lower(text).contains("k")
    scaled = [F.when(in_thousands & (x < 1000), x * 1000).otherwise(x) for x in (low, high)]
    sign = F.when(text.contains("$"), "USD").when(text.contains("€"), "EUR").when(text.contains("£"), "GBP").otherwise("USD")
    return F.struct(scaled[0].alias("salary_min"), scaled[1].alias("salary_max"), F.coalesce(sign, F.lit("USD")).alias("currency"))


def experience_years(text: Column) -> Column:
    """Least years of experience asked for, by the first pattern that matches, or null."""

    def years(plain: Column) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(plain, f"(?iU){p}", 1), F.lit("")).try_cast("int") for p in V.EXPERIENCE])

    return F.when(F.lower(text).contains("year"), bound(_plain(text), years))


def _first(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(v)) for p, v in patterns])


def work_mode(title: Column, text: Column, location: Column) -> Column:
    place = F.lower(F.coalesce(location, F.lit("")))
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    return F.when(place.contains("remote"), F.when(place.contains("hybrid"), "hybrid").otherwise("remote")).otherwise(_first(both, V.REMOTE))


def job_type(title: Column, text: Column) -> Column:
    return F.coalesce(_first(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))), V.JOB_TYPES), F.lit("full_time"))


def level(title: Column) -> Column:
    return F.coalesce(_first(F.coalesce(title, F.lit("")), V.LEVELS), F.lit("mid"))


def visa(text: Column) -> Column:
    return F.when(text.rlike(V.NO_VISA), F.lit(False)).when(text.rlike(V.VISA), F.lit(True))


def technologies(text: Column) -> Column:
    """Known technologies named as words of their own, sorted. The cheap test for the letters goes before each pattern."""

    def named(lower: Column) -> Column:
        hits = [F.when(lower.contains(t.lower()) & lower.rlike(rf"(?U)\b{re.escape(t.lower())}\b"), F.lit(t)) for t in V.TECHNOLOGIES]
        return F.array_sort(F.array_compact(F.array(*hits)))

    return bound(F.lower(text), named)


def metro(location: Column) -> Column:
    """Metro area by the first alias in the location; unknown without one, other elsewhere."""
    place = F.trim(F.lower(F.coalesce(location, F.lit(""))))
    return F.when(place == "", "unknown").otherwise(F.coalesce(*[F.when(place.contains(a), F.lit(m)) for a, m in V.METROS.items()], F.lit("other")))


def _bucket(title: Column, table: dict[str, tuple[str, ...]], other: str) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(*[F.when(t.rlike("|".join(map(re.escape, words))), F.lit(name)) for name, words in table.items()], F.lit(other))


def salary_role(title: Column) -> Column:
    return _bucket(title, V.SALARY_ROLES, "other")


def salary_seniority(title: Column) -> Column:
    return _bucket(title, V.SALARY_SENIORITY, "mid")
