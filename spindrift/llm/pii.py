"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Native DataFrame expressions only, one pass over the table, no shuffle. Patterns are written with possessive
quantifiers and start only where a match can start, so they stay linear and iterative on very long runs. Spans come
from the pieces between matches (split) and the matches themselves, which gives code-point offsets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import columns

#: Code points looked at on either side of a span.
CONTEXT = 40
#: A further (not base) span stays from this score on.
MIN_SCORE = 0.7
#: Length of an account number (IBAN) by country, from the registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
SPAN = "struct<kind:string,start:int,end:int,score:double>"
PLACED = "struct<start:int,end:int,m:string>"
#: Matches folded into one list at a time.
FOLD = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """The mod-97 check of an account number in capitals and digits, its first four characters moved to the end."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def fold(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), fold) == 1


@dataclass(frozen=True)
class Kind:
    """A pattern, what a text must contain for it to match at all, a check, and whole words that raise or lower the score.

    A pattern has no capturing group, or takes only a match's first code points, head of them, and captures the whole
    match looking ahead, so that one that fails its check hides none that starts within it.
    """

    name: str
    pattern: str
    check: Callable[[Column], Column]
    within: str = ""
    base: bool = True
    near: tuple[str, ...] = ()
    against: tuple[str, ...] = ()
    start_score: float = 0.6
    head: int = 0


def _iban() -> str:
    """An account number from its start: as long as its country says, or else up to the last word end that 15 to 34 characters reach."""
    fixed = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?+[A-Z0-9]){{{n - 4}}}+(?![A-Za-z0-9])" for n, codes in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=({fixed}|[A-Z]{{2}}[0-9]{{2}}(?: ?+[A-Z0-9]){{11,30}}(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"


#: Longest run of digits and separators a match may hold is open, so lengths are checked after matching.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "@", near=("mail", "email", "e-mail", "mailto", "contact"), against=("example", "examples")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"), ".", near=("ip", "host", "address", "server"), against=("version", "versions", "release", "releases")),
    Kind("card", r"[0-9](?:[ -]?+[0-9])++", lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m)), near=("card", "cards", "visa", "pay", "payment", "credit"), against=("order", "invoice", "tracking")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(8, 15), "+", near=("phone", "telephone", "call", "tel", "mobile"), against=("fax machine", "total")),
    Kind("iban", _iban(), lambda m: mod97(F.regexp_replace(m, " ", "")), base=False, near=("iban", "bank", "account", "konto", "bankkonto", "compte", "cuenta"), against=("serial", "part number"), head=4),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), "-", base=False, near=("ssn", "social security"), against=("order", "part")),
)


def _score(kind: Kind, around: Column) -> Column:
    """The start score, raised once by a near word and lowered once by a word against."""
    score = F.lit(kind.start_score + (0.2 if kind.name in ("card", "iban") else 0.0))
    for words, step in ((kind.near, 0.2), (kind.against, -0.2)):
        if words:
            score = score + F.when(around.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])"), step).otherwise(0.0)
    return score


def _spans(kind: Kind, text: Column, matches: Column, pieces: Column) -> Column:
    """The kind's spans that pass its check (and the least score, unless base), in order of start."""

    none = F.array().cast(f"array<{PLACED}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["length"]
        return F.struct((start + kind.head if kind.head else end).alias("at"), F.array_append(acc["found"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))).alias("found"))

    def walk(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("found")), step)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["found"], x["found"]).alias("found"))), 0)

    cut = F.filter(F.zip_with(matches, pieces, lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("length"), m.alias("m"))), lambda x: x["m"].isNotNull())
    # Folding in blocks: appending one by one would copy the whole list for every match.
    firsts = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / FOLD).cast("int"))
    blocks = F.transform(firsts, lambda b: F.slice(cut, b * FOLD + 1, F.lit(FOLD)))
    placed = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{PLACED}>>").alias("found")),
        walk,
        lambda acc: F.filter(F.flatten(acc["found"]), lambda x: kind.check(x["m"])),
    )

    def apart(found: Column, x: Column) -> Column:
        return F.when(F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(0)) <= x["start"], F.array_append(found, x)).otherwise(found)

    if kind.head:
        placed = F.aggregate(placed, none, apart)

    def scored(x: Column) -> Column:
        first = F.greatest(x["start"] - CONTEXT, F.lit(0))
        around = F.lower(F.substring(text, first + 1, x["end"] + CONTEXT - first))
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.round(_score(kind, around), 2).alias("score"))

    spans = F.transform(placed, scored)
    return spans if kind.base else F.filter(spans, lambda x: x["score"] >= MIN_SCORE)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, text and spans (array of kind, start, end, score), by kind as listed, then by start; one row a row.

    Offsets are code points, ends exclusive; matches of a kind don't overlap, those of two kinds may. Base kinds
    stay whatever their score. Null and empty texts hold no spans; repeated rows and null ids are rows like others;
    further columns are ignored.
    """
    docs = columns(docs, doc_id=doc_id, text=text)
    return docs.withColumn("spans", span_column(F.coalesce(F.col("text"), F.lit("")), kinds))


def span_column(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The spans of a text that isn't null, as find_personal_data gives them."""
    nothing = F.array().cast(f"array<{SPAN}>")

    def of_kind(kind: Kind) -> Column:
        # Matches are bound to a lambda's variable, so that they are looked for once.
        matches = F.array(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1 if kind.head else 0)))
        found = F.flatten(F.transform(matches, lambda m: F.when(F.size(m) > 0, _spans(kind, text, m, F.split(text, kind.pattern, -1))).otherwise(nothing)))
        return F.when(text.contains(kind.within), found).otherwise(nothing) if kind.within else found

    return F.concat(*map(of_kind, kinds))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def base_spans(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*[k.name for k in kinds if k.base]))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one that starts first, then the longest, stands."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), F.array_append(acc["out"], F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("out")))

    order = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("far"), x["end"].alias("end"), x["kind"].alias("kind")))
    done = F.aggregate(F.array_sort(order), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(F.array(done), F.lit(""), lambda _, d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text)))))
