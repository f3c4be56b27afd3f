"""Stems, the inverted index, web-style queries and ranks."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions.stem import ENGLISH_STOPS, stem
from spindrift.operators.textindex import BUCKETS, WEIGHTS, Index, parse_query, search
from spindrift.scratch import scratch_path

STEMS = """consign consign consigned consign consigning consign consignment consign consistency consist consistently consist consolatory consolatori consolations consol
conspicuous conspicu conspiracy conspiraci constable constabl constancy constanc knack knack knackeries knackeri knavish knavish kneeling kneel knives knive knitted knit
generate generat general general generously generous hoping hope hopping hop luxuriate luxuri cries cri ties tie gas gas gaps gap kiwis kiwi agreed agre feed feed happy happi by by say say
skies sky dying die news news inning inning proceeding proceed communication communic relational relat conditional condit rational ration engineers engin engineering engin
licenses licens licensed licens licensing licens hopefulness hope replacement replac adoption adopt controlling control bed bed youth youth enjoying enjoy flies fli abilities abil early earli"""


def test_stems():
    words = STEMS.split()
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))


def test_queries_become_alternatives_of_stems():
    assert [[(p.wanted, p.stems) for p in g] for g in parse_query('Engineers -"senior of engineering" or the or "data')] == [[(True, (("engin", 0),)), (False, (("senior", 0), ("engin", 2)))], [(True, (("data", 0),))]]
    assert parse_query('the -of ""') == []


def plain(docs, query):
    """All documents tried one by one, every pair of places looked at."""
    words = {}
    for d, fields in docs.items():
        held, start = [], 0
        for weight, text in zip(WEIGHTS, fields, strict=False):
            found = [(stem(w), i, weight) for i, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower()), 1) if w not in ENGLISH_STOPS]
            held += [(s, start + i, w) for s, i, w in found]
            start += max((i for _, i, _ in found), default=0)
        words[d] = held
    groups = parse_query(query)
    terms = sorted({s for g in groups for p in g for s, _ in p.stems})
    out = {}
    for d, held in words.items():
        at = {t: [(i, w) for s, i, w in held if s == t] for t in terms}

        def holds(p, at=at):
            return any(all(any(j == i + o for j, _ in at[s]) for s, o in p.stems) for i, _ in at[p.stems[0][0]])

        if not any(all(holds(p) == p.wanted for p in g) for g in groups):
            continue
        if len(groups) == 1 and len([s for p in groups[0] for s in p.stems]) > 1 and len(terms) > 1:
            rest, pairs = 1.0, 0
            for x in range(len(terms)):
                for y in range(x):
                    for i, v in at[terms[x]]:
                        for j, w in at[terms[y]]:
                            if gap := abs(i - j):
                                rest *= 1 - math.sqrt(v * w * (1e-30 if gap > 100 else 1 / (1.005 + 0.05 * math.exp(gap / 1.5 - 2))))
                                pairs += 1
            out[d] = 1 - rest if pairs else 1e-20
        else:
            total = 0.0
            for t in terms:
                weights = [w for _, w in at[t]]
                if weights:
                    best = weights.index(max(weights))
                    total += (weights[best] + sum(w / (n + 1) ** 2 for n, w in enumerate(weights)) - weights[best] / (best + 1) ** 2) / 1.64493406685
            out[d] = total / len(terms)
    return out


QUERIES = ["engineer", '"data engineer"', "data -manager", "manager or engineering", "-remote", '"head of data" or paris', "data engineers remote", "the", "nowhere", 'data "nowhere else"', "paris paris", '-"data engineer" remote']


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = ["data", "engineer", "engineering", "manager", "of", "the", "remote", "Paris", "head", "é", "x1"]
    docs = {i: tuple(" ".join(rng.choice(words) for _ in range(rng.randint(0, n))) or None for n in (4, 3, 3, 160)) for i in range(120)}
    docs[500] = ("head of data", None, None, None)
    frame = spark.createDataFrame([(i, *f, "t", 1) for i, f in docs.items()], "id long, a string, b string, c string, d string, term string, bucket int").repartition(3)
    index = Index(scratch_path(spark, "index")).add(frame, "id", [F.col(c) for c in "abcd"])
    return docs, frame, index


@pytest.mark.parametrize("query", QUERIES)
def test_search_against_every_document(spark, corpus, query):
    docs, _, index = corpus
    got = {r.doc: r["rank"] for r in search(spark, index, query).collect()}
    assert got == pytest.approx(plain(docs, query), abs=1e-9)


def test_only_the_buckets_of_the_stems_are_read(spark, corpus):
    _, _, index = corpus
    files = index.postings(spark, ["engin", "remot"]).inputFiles()
    held = {int(re.search(r"bucket=(\d+)", f)[1]) for f in files}
    want = {r[0] for r in spark.createDataFrame([("engin",), ("remot",)], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS))).collect()}
    assert held == want
    plan = search(spark, index, "engineer")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,engin)]" in plan


def test_documents_written_again_take_the_place_of_earlier_ones(spark, corpus):
    docs, frame, _ = corpus
    index = Index(scratch_path(spark, "index")).add(frame, "id", [F.col(c) for c in "abcd"])
    news = {3: ("wombat", None, None, None), 900: ("wombat keeper", "data", None, None), 7: (None, None, None, None)}
    index = index.add(spark.createDataFrame([(i, *f) for i, f in news.items()], "id long, a string, b string, c string, d string"), "id", [F.col(c) for c in "abcd"])
    for query in ("wombats", "data", "-data", "data or wombat"):
        assert {r.doc: r["rank"] for r in search(spark, index, query).collect()} == pytest.approx(plain(docs | news, query), abs=1e-9)


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (None, "data"), (3, "data " * 30_000 + "engineer"), (4, "the of")]
    index = Index(scratch_path(spark, "index")).add(spark.createDataFrame(rows, "id long, a string"), "id", [F.col("a")])
    assert [r.doc for r in search(spark, index, "data engineer").collect()] == [3]
    assert sorted(r.doc for r in search(spark, index, "-data").collect()) == [1, 2, 4]
    empty = Index(scratch_path(spark, "index")).add(spark.createDataFrame([], "id long, a string"), "id", [F.col("a")])
    assert search(spark, empty, "data or -x").count() == 0
    with pytest.raises(ValueError):
        Index("x").add(spark.createDataFrame([], "id long, a string"), "id", [])
