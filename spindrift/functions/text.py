"""Text expressions: HTML to text, tokens, normalised titles, labels."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.vocabulary import STOP_WORDS

#: Names that most texts use; they come first in the table, as it is searched in order.
COMMON = ("amp", "lt", "gt", "quot", "apos", "nbsp", "ndash", "mdash", "rsquo", "lsquo", "rdquo", "ldquo", "hellip", "bull", "copy", "reg", "eacute")
#: Names that count without a semicolon too, the longest first.
BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def bound(value: Column, use: Callable[[Column], Column], kind: str | None = None) -> Column:
    """use(value) with the value computed once: as a lambda's variable, which no later rule copies.

    Of several nested ones, all name the result's type: reading an array's element works out the type of all that lies
    within, for every row and level anew, while an aggregate has it from its first value.
    """
    if kind:
        return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: use(x))
    return F.get(F.transform(F.array(value), use), 0)


def _windows(code: int) -> str:
    """What a number from 0x80 to 0x9F stands for."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _table(pairs: dict) -> Column:
    """A map of texts as one literal, which the optimizer folds once."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def _of_number(code: Column) -> Column:
    """The text of a numeric reference: surrogates and numbers beyond Unicode are a replacement mark, controls and non-characters nothing."""
    known = _table({0: "\ufffd", 13: "\r"} | {c: _windows(c) for c in range(0x80, 0xA0)})  # by number
    nothing = code.between(1, 8) | (code == 11) | code.between(14, 31) | code.between(127, 159) | code.between(0xFDD0, 0xFDEF) | code.bitwiseAND(0xFFFE).eqNullSafe(0xFFFE)
    mark = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(known, code.cast("string")), F.when(code.isNull() | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").when(nothing, "").otherwise(mark))


def unescape(text: Column, unclosed: bool = True) -> Column:
    """Numeric and named references resolved, each once; what is no reference stays as it is, nor is one without a semicolon if unclosed is false."""
    named = {f"{n};": html5[f"{n};"] for n in COMMON} | {n: v for n, v in html5.items() if n.endswith(";")}
    bare = "|".join(map(re.escape, BARE))

    def numeric(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "^#[xX]?0*([0-9a-fA-F]*)", 1)
        # Numbers of over eight digits are beyond Unicode whatever they are.
        number = F.when(F.length(digits) > 8, F.lit(0x110000)).when(reference.rlike("^#[xX]"), F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("long")).otherwise(F.concat(F.lit("0"), digits).try_cast("long"))
        return bound(number, _of_number, "string")

    def brief(part: Column) -> Column:
        short = F.regexp_extract(part, f"^({bare})", 1)
        return bound(short, lambda x: F.when(x != "", F.concat(F.try_element_at(_table({n: html5[n] for n in BARE}), x), F.substring(part, F.length(x) + 1, F.length(part)))), "string")

    def resolved(part: Column) -> Column:
        def whole(reference: Column) -> Column:
            mark = F.when(reference.startswith("#"), numeric(reference)).when(reference != "", F.try_element_at(_table(named), reference))
            return F.concat(mark, F.substring(part, F.length(reference) + 1, F.length(part)))

        end = ";?" if unclosed else ";"
        full = bound(F.regexp_extract(part, rf"^(#[xX][0-9a-fA-F]+{end}|#[0-9]+{end}|[A-Za-z][A-Za-z0-9]{{1,31}};)", 1), whole, "string")
        return F.coalesce(full, *([brief(part)] if unclosed else []), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.when(text.contains("&"), F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(resolved(p))), "")).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space of any kind collapsed to one space each, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", " "))


def html_to_text(html: Column, unclosed: bool = True) -> Column:
    """Entities resolved (those without a semicolon too, unless unclosed is false), tags to spaces, white space collapsed."""
    return squeeze(F.regexp_replace(unescape(F.coalesce(html, F.lit("")), unclosed), r"<[^>]+>", " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case words without stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")), r"(?U)\s+")
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, [*STOP_WORDS, ""])))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


#: What a title is cleared of, in this order, wherever it stands.
TITLE_WORDS = ("senior ", "sr ", "sr. ", "junior ", "jr ", "jr. ", "lead ", "principal ", "staff ", "associate ")


def title_key(title: Column) -> Column:
    """Blocking key of a title: without seniority words, parentheses and a trailing place."""
    t = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    for word in TITLE_WORDS:
        t = F.replace(t, F.lit(word), F.lit(""))
    t = F.regexp_replace(t, r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(t, r"\s*[-–|]\s*[^-–|]*$", ""))


def shorten(text: Column, longest: int) -> Column:
    """At most longest characters: longer ones keep three less, trimmed, and three dots."""
    return F.when(F.length(text) > longest, F.concat(F.trim(F.substring(text, 1, longest - 3)), F.lit("..."))).otherwise(text)


def location_label(location: Column) -> Column:
    raw = squeeze(F.coalesce(location, F.lit("")))
    unknown = (raw == "") | raw.rlike(r"(?i)^(unknown|n/a|none|null|not specified|location tbd)$")
    return F.when(unknown, "Remote").otherwise(shorten(raw, 42))


def company_label(company: Column, source: Column) -> Column:
    raw = squeeze(F.coalesce(company, F.lit("")))
    return F.when((raw == "") | raw.rlike(r"(?i)^(unknown|n/a|none|null)$"), source).otherwise(shorten(raw, 72))


def slugify(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-"), F.lit("-"))


def description(text: Column, longest: int = 4000) -> Column:
    """Trimmed, blank as null, capped and trimmed again on the right."""
    t = F.nullif(F.trim(text), F.lit(""))
    return F.when(F.length(t) > longest, F.rtrim(F.substring(t, 1, longest))).otherwise(t)


def content_key(title: Column, company: Column, location: Column) -> Column:
    """16 hex digits over title, company and location."""
    return F.substring(F.sha2(F.lower(F.trim(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (title, company, location)]))), 256), 1, 16)


def natural_key(source: Column, company: Column, job_id: Column, url: Column) -> Column:
    """source::company::id in lower case; the url stands in for a missing or blank id."""
    part = F.coalesce(F.nullif(F.trim(job_id), F.lit("")), url, F.lit(""))
    return F.concat_ws("::", *[F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (source, company, part)])


def weighted_length(text: Column) -> Column:
    """Characters as short-message services count them: an address is 23, East Asian and other wide ones 2, the rest 1."""
    plain = F.regexp_replace(text, r"https?://\S+", "")
    links = F.size(F.regexp_extract_all(text, F.lit(r"https?://\S+"), F.lit(0)))
    narrow = F.length(F.regexp_replace(plain, r"[^\x{0}-\x{10FF}\x{2000}-\x{200D}\x{2010}-\x{201F}\x{2032}-\x{2037}]", ""))
    return links * 23 + 2 * F.length(plain) - narrow
