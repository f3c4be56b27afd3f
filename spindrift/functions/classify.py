"""Classifiers and gates as column expressions; orders of precedence are those of the lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import urls
from spindrift.functions import vocabulary as V
from spindrift.functions.text import bound, squeeze


def _any_word(words) -> str:
    return "|".join(map(re.escape, words))


def _holds(text: Column, words) -> Column:
    """Whether any word is in the text; plain searches beat one long alternation."""
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def roles(title: Column, years: Column | None = None) -> Column:
    """Categories of a title in order of priority; early careers join New Grad unless a senior word stands beside."""
    names = {c: f"c{i}" for i, c in enumerate(V.CATEGORY_ORDER)}

    def judged(t: Column) -> Column:
        # A term that holds another of its category can't add to it.
        hits = F.struct(*[_holds(t, [w for w in V.ROLE_TERMS[c] if not any(o != w and o in w for o in V.ROLE_TERMS[c])]).alias(n) for c, n in names.items()])

        def listed(hit: Column) -> Column:
            any_role = F.lit(False)
            for n in names.values():
                any_role = any_role | hit[n]
            early = t.rlike(V.EARLY_ALONE) | (any_role & t.rlike(V.EARLY_BESIDE))
            if years is not None:
                early = early | (any_role & F.coalesce(years <= 2, F.lit(False)))
            junior = (hit[names["New Grad"]] | early) & ~t.rlike(V.SENIOR)
            return F.array_compact(F.array(*[F.when(junior if c == "New Grad" else hit[n], F.lit(c)) for c, n in names.items()]))

        return bound(hits, listed)

    return bound(F.lower(F.coalesce(title, F.lit(""))), judged)


def role_weight(categories: Column) -> Column:
    """The greatest weight among categories; null for none."""
    weights = F.create_map(*[F.lit(x) for pair in V.ROLE_WEIGHTS.items() for x in pair])
    return F.array_max(F.transform(categories, lambda c: F.coalesce(F.try_element_at(weights, c), F.lit(V.OTHER_WEIGHT))))


def primary_category(categories: Column) -> Column:
    return F.when(F.array_contains(categories, "New Grad"), "New Grad").otherwise(F.coalesce(F.get(categories, 0), F.lit("Uncategorized")))


def board_category(categories: Column, title: Column) -> Column:
    """Data, AI/ML, SWE or Other: by stored categories first, then by words of the title."""
    data = F.arrays_overlap(categories, F.array(*map(F.lit, ("Data Engineering", "Data Science", "Data Analyst"))))
    t = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(categories, " ")))
    stored = F.get(F.filter(F.transform(categories, lambda c: F.when(c.isin("Data Engineering", "Data Science", "Data Analyst"), "Data").when(c.isin("AI/ML", "SWE"), c).when(c.isin("Product", "Research", "New Grad", "Uncategorized"), "Other")), lambda c: c.isNotNull()), 0)
    words = (
        F.when(t.rlike(r"\b(data scientist|analytics scientist|data engineer|analytics engineer|etl|data platform|data analyst|business intelligence analyst|bi analyst|reporting analyst)\b"), "Data")
        .when(t.rlike(r"\b(ai|ml|machine learning|llm|research scientist|deep learning)\b"), "AI/ML")
        .when(t.rlike(r"\b(software engineer|software developer|frontend|backend|full stack|fullstack|devops|sre|infrastructure|platform engineer|mobile engineer|ios engineer|android engineer|security engineer)\b"), "SWE")
        .otherwise("Other")
    )
    return F.when(F.size(categories) > 0, F.coalesce(stored, F.when(data, "Data"), words)).otherwise(words)


def is_us_permissive(location: Column, exclude: str = V.NON_US) -> Column:
    """Everything but places on the exclude list; blank and unknown pass."""
    place = F.trim(F.coalesce(location, F.lit("")))
    return (place == "") | ~place.rlike(exclude)


def is_us_strict(location: Column) -> Column:
    place = squeeze(F.coalesce(location, F.lit("")))
    foreign = place.rlike(V.NON_US) | place.rlike(V.NON_US_CODE)
    return F.when(place == "", False).when(F.lower(place) == "remote", True).when(foreign, False).otherwise(place.rlike(V.US_NAME) | place.rlike(V.US_CODE))


def _blocked(url: Column, tokens: tuple[str, ...] = V.BLOCKED_URL_TOKENS) -> Column:
    tail = F.lower(F.concat(urls.path(url), F.lit("?"), urls.query(url)))
    return tail.rlike(_any_word(tokens))


def _aggregator(url: Column) -> Column:
    return urls.host(url).rlike("(" + _any_word(V.AGGREGATOR_HOSTS) + ")$")


def quality(title: Column, company: Column, url: Column, source: Column) -> Column:
    """(state, reasons, confidence): accepted without reasons, rejected for hard ones, needs_review otherwise."""
    title, company, url = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, company, url))
    source = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    reasons = F.array_compact(
        F.array(
            F.when(~source.isin(*V.DIRECT_SOURCES), "non_direct_source"),
            F.when(urls.host(url) == "", "invalid_apply_url"),
            F.when(_blocked(url), "non_job_url"),
            F.when(_aggregator(url), "aggregator_host"),
            F.when((F.length(title) < 4) | title.rlike(V.GENERIC_TITLE), "generic_title"),
            F.when((company == "") | F.lower(company).isin(*V.NO_COMPANY), "unknown_company"),
            F.when(company.contains("@") & F.lower(company).contains(F.lower(title)), "malformed_company_title"),
        )
    )

    def has(*names: str) -> Column:
        return F.arrays_overlap(reasons, F.array(*map(F.lit, names)))

    less = F.when(has("non_direct_source"), 0.45).otherwise(0.0) + F.when(has("invalid_apply_url", "non_job_url", "aggregator_host"), 0.35).otherwise(0.0) + F.when(has("generic_title", "unknown_company", "malformed_company_title"), 0.25).otherwise(0.0)
    state = F.when(F.size(reasons) == 0, "accepted").when(has("invalid_apply_url", "non_job_url", "aggregator_host", "generic_title"), "rejected").otherwise("needs_review")
    return F.struct(state.alias("state"), reasons.alias("reasons"), F.greatest(F.lit(0.0), F.bround(1.0 - less, 2)).alias("confidence"))


def quality_score(title: Column, text: Column, salary_min: Column, categories: Column, is_hot: Column) -> Column:
    """0-100: hot companies, salary, freshness, length of text, role weight and title."""
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    total = F.when(F.coalesce(is_hot, F.lit(False)), 25.0).otherwise(0.0) + F.when(F.coalesce(salary_min > 0, F.lit(False)), 15.0).otherwise(0.0) + 10.0
    total = total + F.when(F.length(text) > 500, 8.0).when(F.length(text) > 100, 4.0).otherwise(0.0)
    total = total + F.coalesce(role_weight(categories) * 20, F.lit(0.0))
    total = total + F.when(F.length(title) > 100, -10.0).when(F.length(title) < 60, 5.0).otherwise(0.0)
    total = total - F.when(F.lower(title).rlike(_any_word(V.EXECUTIVE)), 30.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def first_failure(title: Column, company: Column, location: Column, url: Column, source: Column, us_only: bool = True) -> Column:
    """The first check a posting fails before it may be pushed, or null."""
    title, company = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, company))
    source = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    checks = [
        (urls.host(url) == "", "invalid_url"),
        (F.length(title) < 4, "missing_title"),
        ((company == "") | F.lower(company).isin(*V.NO_COMPANY), "unknown_company"),
        (company.rlike(V.BAD_COMPANY), "bad_company"),
        (title.rlike(V.GENERIC_TITLE), "generic_title"),
        (F.lit(us_only) & ~is_us_strict(location), "non_us_location"),
        (_blocked(url, V.PUSH_BLOCKED_URL_TOKENS), "non_job_url"),
        (source.isin("indeed", "careerbuilder", "ziprecruiter"), "blocked_aggregator"),
        (_aggregator(url), "blocked_aggregator"),
        (~source.isin(*V.DIRECT_SOURCES) & (F.lower(company) == "unknown"), "untrusted_unknown_company"),
    ]
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in checks])


def failure(status: Column, message: Column) -> Column:
    """Class of a failed fetch: by status code, then by words, in the order of the list."""
    words = F.lower(F.coalesce(message, F.lit("")))
    out = [F.when(F.coalesce(status.isin(*codes), F.lit(False)) if codes else F.lit(False), F.lit(name)).when(words.rlike(_any_word(tokens)) if tokens else F.lit(False), F.lit(name)) for name, codes, tokens in V.FAILURES]
    return F.coalesce(*out, F.when(status >= 500, "connection"), F.lit("unknown"))


def stage(text: Column) -> Column:
    """Tracker stages folded to those of the pipeline."""
    return F.when(text.isin("oa", "phone_screen", "onsite"), "interview").when(text == "withdrawn", "rejected").otherwise(text)


#: Bases of a target's priority and seconds between visits, by tier.
TIER_BASE = {"P0": 100.0, "P1": 60.0, "P2": 20.0, "P3": 5.0}
TIER_SECONDS = {"P0": 900, "P1": 3600, "P2": 86_400, "P3": 604_800}


def priority(tier: Column, sources: Column, jobs: Column, relevant: Column, failures: Column, last_job: Column, now: Column) -> Column:
    """Rank of a target: tier, capped counters, failures, how recently it had a posting."""
    base = F.coalesce(*[F.when(tier == t, F.lit(b)) for t, b in TIER_BASE.items()], F.lit(20.0))
    hours = F.when(last_job.isNotNull(), F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(last_job)) / 3600))
    total = base + F.least(F.coalesce(sources, F.lit(1)), F.lit(10)) * 0.5 + F.least(F.coalesce(jobs, F.lit(0)), F.lit(100)) * 0.2
    total = total + F.least(F.coalesce(relevant, F.lit(0)), F.lit(50)) * 1.5 - F.coalesce(failures, F.lit(0)) * 8
    return F.greatest(F.lit(0.0), F.bround(total + F.when(hours < 24, 25).when(hours < 168, 10).otherwise(0), 2))


def next_due_seconds(tier: Column, failures: Column, jobs: Column, relevant: Column, failed: Column) -> Column:
    """Seconds until a target is due again."""
    base = F.coalesce(*[F.when(tier == t, F.lit(s)) for t, s in TIER_SECONDS.items()], F.lit(86_400))
    n = F.coalesce(failures, F.lit(0))
    week = F.lit(604_800)
    return F.when(failed, F.least(week, base * F.greatest(F.lit(2), F.least(F.lit(8), n + 1)))).when(relevant > 0, F.least(base, F.lit(3600))).when(jobs > 0, F.least(base, F.lit(14_400))).when(n >= 5, F.least(week, base * 3)).otherwise(base).cast("long")
