"""Full-text searches over an index of the documents, with SQL that tokenises, stems, matches and ranks by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.stem import ENGLISH_STOPS, FOURTH, IRREGULAR, SECOND, SETTLED, THIRD, UNCHANGED, WHOLE
from spindrift.operators import textindex
from spindrift.plans.catalog import QUERIES, SQL, table
from spindrift.scratch import scratch_path


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _ending(step, region) -> str:
    """The longest ending that a word has is replaced if it lies in its region and what stands before it fits."""
    cases = []
    for ending, instead in step:
        before = {"ogi": " AND substr(x, length(x) - 3, 1) = 'l'", "li": " AND regexp_matches(x, '[cdeghkmnrt]li$')", "ion": " AND regexp_matches(x, '[st]ion$')"}.get(ending, "")
        cases.append(f"WHEN suffix(x, '{ending}') THEN CASE WHEN length(x) - {len(ending)} >= {region(ending)}{before} THEN substr(x, 1, length(x) - {len(ending)}) || '{instead}' ELSE x END")
    return f"CASE {' '.join(cases)} ELSE x END"


def _stems(words: str) -> str:
    """CTEs ending in stems(w, s) for the distinct words of a table of (w)."""
    short = "(regexp_matches({0}, '(^|[^aeiouy])[aeiouy][^aeiouywxY]$') OR regexp_matches({0}, '^[aeiouy][^aeiouy]$'))"
    keep = "w, x0, r1, r2"
    ahead = "^.*?[aeiouy][^aeiouy]"
    past = "regexp_extract(x, '^(.*?[aeiouy].*?)(edly|ingly|ed|ing)$', 1)"
    return f"""
y0 AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS x FROM (SELECT DISTINCT w FROM {words})),
y1 AS (SELECT w, x AS x0, x, CASE {" ".join(f"WHEN starts_with(x, '{p}') THEN {len(p)}" for p in WHOLE)} WHEN regexp_matches(x, '{ahead}') THEN length(regexp_extract(x, '{ahead}')) ELSE length(x) END AS r1 FROM y0),
y2 AS (SELECT *, CASE WHEN regexp_matches(substr(x, r1 + 1), '{ahead}') THEN r1 + length(regexp_extract(substr(x, r1 + 1), '{ahead}')) ELSE length(x) END AS r2 FROM y1),
y3 AS (SELECT {keep}, CASE WHEN suffix(x, 'sses') THEN substr(x, 1, length(x) - 2) WHEN suffix(x, 'ied') OR suffix(x, 'ies') THEN substr(x, 1, length(x) - CASE WHEN length(x) > 4 THEN 2 ELSE 1 END)
  WHEN suffix(x, 's') AND NOT suffix(x, 'us') AND NOT suffix(x, 'ss') AND regexp_matches(substr(x, 1, length(x) - 2), '[aeiouy]') THEN substr(x, 1, length(x) - 1) ELSE x END AS x FROM y2),
y4 AS (SELECT {keep}, x, x IN ({_quoted(SETTLED)}) AS settled, CASE WHEN regexp_matches(x, 'eed(ly)?$') THEN '' ELSE {past} END AS cut FROM y3),
y5 AS (SELECT {keep}, settled, CASE WHEN settled THEN x WHEN suffix(x, 'eed') THEN CASE WHEN length(x) - 3 >= r1 THEN substr(x, 1, length(x) - 1) ELSE x END WHEN suffix(x, 'eedly') THEN CASE WHEN length(x) - 5 >= r1 THEN substr(x, 1, length(x) - 3) ELSE x END
  WHEN cut = '' THEN x WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e' WHEN regexp_matches(cut, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN substr(cut, 1, length(cut) - 1) WHEN r1 >= length(cut) AND {short.format("cut")} THEN cut || 'e' ELSE cut END AS x FROM y4),
y6 AS (SELECT {keep}, settled, CASE WHEN NOT settled AND length(x) > 2 AND regexp_matches(x, '[^aeiouy][yY]$') THEN substr(x, 1, length(x) - 1) || 'i' ELSE x END AS x FROM y5),
y7 AS (SELECT {keep}, settled, CASE WHEN settled THEN x ELSE {_ending(SECOND, lambda e: "r1")} END AS x FROM y6),
y8 AS (SELECT {keep}, settled, CASE WHEN settled THEN x ELSE {_ending(THIRD, lambda e: "r2" if e == "ative" else "r1")} END AS x FROM y7),
y9 AS (SELECT {keep}, settled, CASE WHEN settled THEN x ELSE {_ending([(e, "") for e in FOURTH], lambda e: "r2")} END AS x FROM y8),
y10 AS (SELECT w, CASE WHEN settled THEN x WHEN suffix(x, 'e') AND (length(x) - 1 >= r2 OR length(x) - 1 >= r1 AND NOT {short.format("substr(x, 1, length(x) - 1)")}) THEN substr(x, 1, length(x) - 1) WHEN suffix(x, 'll') AND length(x) - 1 >= r2 THEN substr(x, 1, length(x) - 1) ELSE x END AS x FROM y9),
stems AS MATERIALIZED (SELECT w, CASE WHEN length(w) < 3 OR w IN ({_quoted(UNCHANGED)}) THEN w {" ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in IRREGULAR.items())} ELSE lower(x) END AS s FROM y10)"""


def _sql(words: list[str], matches: str, rank: str, everything: bool = False) -> str:
    """One search: hits holds the places of the query's stems, named q1.. in order of its words."""
    return rf"""
WITH f AS (SELECT doc_id, unnest([0, 1, 2]) AS field, unnest([source, lang, text]) AS x FROM documents),
l AS (SELECT doc_id, field, regexp_extract_all(lower(coalesce(x, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS ws FROM f),
t AS (SELECT doc_id, field, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l),
k AS (SELECT * FROM t WHERE w NOT IN ({_quoted(ENGLISH_STOPS)})),
ends AS (SELECT d.doc_id, d.field, sum(coalesce(e.n, 0)) OVER (PARTITION BY d.doc_id ORDER BY d.field ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f d LEFT JOIN (SELECT doc_id, field, max(i) AS n FROM k GROUP BY 1, 2) e USING (doc_id, field)),
query AS (SELECT unnest([{_quoted(words)}]) AS w, unnest(range({len(words)})) AS q),
vocabulary AS (SELECT w FROM k UNION SELECT w FROM query),
{_stems("vocabulary")},
wanted AS (SELECT s, min(q) AS q FROM query JOIN stems USING (w) GROUP BY 1),
hits AS MATERIALIZED (SELECT doc_id, q, i + coalesce(before, 0) AS at_, [1.0, 0.4, 0.2][field + 1]::DOUBLE AS weight FROM k JOIN stems USING (w) JOIN wanted USING (s) JOIN ends USING (doc_id, field)),
docs AS (SELECT DISTINCT doc_id FROM {"documents" if everything else "hits"}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, q ORDER BY at_) AS n FROM hits),
single AS (SELECT doc_id, (max(weight) + sum(weight / n ** 2) - max(weight) / min(n) FILTER (WHERE weight = best) ** 2) / 1.64493406685 AS r FROM (SELECT *, max(weight) OVER (PARTITION BY doc_id, q) AS best FROM numbered) GROUP BY doc_id, q),
any_rank AS (SELECT doc_id, sum(r) / (SELECT count(*) FROM wanted) AS rank FROM single GROUP BY 1),
all_rank AS (SELECT a.doc_id, 1 - exp(sum(ln(1 - sqrt(a.weight * b.weight * CASE WHEN abs(a.at_ - b.at_) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.at_ - b.at_) / 1.5 - 2)) END)))) AS rank
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.q < b.q AND a.at_ <> b.at_ GROUP BY 1)
SELECT doc_id, round(coalesce(rank, 0), 6) AS rank FROM docs LEFT JOIN {rank} USING (doc_id) WHERE {matches}
"""


def _has(q: int) -> str:
    return f"doc_id IN (SELECT doc_id FROM hits WHERE q = {q})"


def _follows(a: int, b: int) -> str:
    return f"doc_id IN (SELECT a.doc_id FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.q = {a} AND b.q = {b} AND b.at_ = a.at_ + 1)"


def _query(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fields = [F.col("source"), F.col("lang"), F.col("text")]
        index = textindex.Index(scratch_path(spark, "text-index")).add(table(spark, sf_dir, "documents"), "doc_id", fields)
        return textindex.search(spark, index, text).select(F.col("doc").alias("doc_id"), F.round("rank", 6).alias("rank"))

    run.__doc__ = f"Documents that the search {text!r} finds, with their rank; the index is written first."
    QUERIES[name], SQL[name] = run, sql


_query("fulltext_any", '"license version" or eriner -rely or src1', _sql(["license", "version", "eriner", "rely", "src1"], f"{_follows(0, 1)} OR ({_has(2)} AND NOT {_has(3)}) OR {_has(4)}", "any_rank"))
_query("fulltext_together", "erers the thlying onings", _sql(["erers", "thlying", "onings"], f"{_has(0)} AND {_has(1)} AND {_has(2)}", "all_rank"))
_query("fulltext_phrase", '"releasing under licenses" or "eriner thanea"', _sql(["releasing", "licenses", "eriner", "thanea"], f"doc_id IN (SELECT a.doc_id FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.q = 0 AND b.q = 1 AND b.at_ = a.at_ + 2) OR {_follows(2, 3)}", "any_rank"))
_query("fulltext_without", "-licensed -relying", _sql(["licensed", "relying"], f"NOT {_has(0)} AND NOT {_has(1)}", "all_rank", everything=True))
