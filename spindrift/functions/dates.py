"""Dates as sources write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order they are tried.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss")
MAIL_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")


def parse(text: Column) -> Column:
    """A timestamp, or null: ISO variants, mail dates, a date alone (its last second), seconds or milliseconds since 1970."""
    t = F.trim(text)
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(t, F.lit(" 23:59:59")), F.lit("yyyy-MM-dd HH:mm:ss")))
    number = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
    epoch = F.timestamp_seconds(F.when(number > 1e12, number / 1000).when(number < 1e11, number))
    iso = [F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]
    mail = [F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3}, ", ""), F.lit(f)) for f in MAIL_FORMATS]
    return F.coalesce(*iso, day, *mail, epoch)


def within(text: Column, now: Column, hours: int) -> Column:
    """Whether a date lies in the last hours; what can't be read is kept, words for months or years count as 30 days."""
    t = F.lower(F.coalesce(text, F.lit("")))
    days = F.regexp_extract(t, r"(\d+)\+?\s*day", 1).try_cast("long")
    spoken = F.when(t.rlike("month|year"), F.lit(hours >= 720)).when(days.isNotNull(), days * 24 <= hours)
    return F.coalesce(parse(text) >= now - F.make_dt_interval(hours=F.lit(hours)), spoken, F.lit(True))


def fresh(posted: Column, first_seen: Column, cutoff: Column) -> Column:
    """Posted (or else first seen) at or after the cutoff; unknown ages are kept."""
    return F.coalesce(F.coalesce(parse(posted), first_seen) >= cutoff, F.lit(True))


def urgency(posted: Column, now: Column) -> Column:
    hours = (F.unix_timestamp(now) - F.unix_timestamp(posted)) / 3600
    return F.when(hours < 2, "hot").when(hours < 12, "recent").otherwise("default")
