"""Queries and expressions that failed on larger tables or odd texts."""

import itertools
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.functions import classify, extract, text
from spindrift.functions import vocabulary as V
from spindrift.operators import setjoin, similar, textindex
from spindrift.plans import catalog, ordered  # noqa: F401


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_html_text_keeps_references_cut_before_their_semicolon(spark, tmp_path):
    pages = ["<title>ver&amp</title>x", "<p>a &am</p>&amp;lt; &#65 &#65", "&copy; &middot &nbsp;b", ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in catalog.QUERIES["html_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == set(con.execute(catalog.SQL["html_text"]).fetchall())
    assert values(spark, [(pages[0],)], "h string", text.html_to_text(F.col("h"))) == ["ver& x"]


def test_similar_sets_across_parts_and_shards_equal_brute_force(spark, monkeypatch):
    """near_duplicate_pairs, cluster_survivors: sets of one word to thousands, dealt over parts and over shards of few sets."""
    monkeypatch.setattr(setjoin, "SHARD", 25)
    rnd, rows = random.Random(3), []
    for n in (1, 2, 5, 30, 127, 128, 400, 700, 2000):
        for _ in range(6):
            base = [f"w{rnd.randrange(9000)}" for _ in range(n)]
            for changed in (0, n // 10, n // 4, n // 3):
                tokens = sorted({*base[changed:], *(f"v{rnd.randrange(9000)}" for _ in range(changed))})
                rows.append((len(rows), rnd.choice("xy"), rnd.choice(["s", "t", None]), tokens))
    sets = spark.createDataFrame(rows, "id long, block string, only string, tokens array<string>")
    got = {(r.a, r.b) for r in similar.similar_sets(sets).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and not (a[2] == b[2] is not None) and len(set(a[3]) & set(b[3])) / len(set(a[3]) | set(b[3])) >= 0.6}
    assert got == want and len(want) > 60
    words = sets.select("id", "block", "only", F.transform("tokens", lambda t: F.shiftright(F.xxhash64(t), 32).cast("int")).alias("words"))
    assert setjoin.candidates(words, 0.6).count() < 2 * len(want)  # texts are joined for few pairs that aren't similar


def test_roles_lower_a_title_once(spark):
    """role_categories, posting_signals: the title is no copy in each of the terms' searches."""
    plan = spark.range(1).select(classify.roles(F.concat(F.lit("Senior Data Engineer "), F.col("id").cast("string"))).alias("r"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r.r for r in plan.collect()] == [["Data Engineering"]]


def test_blocks_unpack_in_runs_of_bounded_places():
    """fulltext_without, fulltext_phrase: a batch of many large blocks is not unpacked at once."""
    blocks = pa.RecordBatch.from_pylist([{"term": f"t{i}", "docs": [i, i + 1], "counts": [1, 99_999], "places": list(range(100_000)), "write": 0} for i in range(6)])
    out = list(textindex._unpacked(iter([blocks])))
    assert len(out) == 3 and sum(b.num_rows for b in out) == 12
    rows = pa.Table.from_batches(out).to_pylist()
    assert [(r["term"], r["doc"], len(r["places"])) for r in rows[:3]] == [("t0", 0, 1), ("t0", 1, 99_999), ("t1", 1, 1)]
    assert rows[9]["places"][:2] == [1, 2] and rows[10]["term"] == "t5"


def test_a_salary_is_worked_out_once(spark):
    """salary_extract, posting_signals: a text, what is found in it and its amounts are no copies in each place that uses them."""
    said = F.concat(F.lit("Made $2m in revenue; SALARY: $"), F.col("id").cast("string"), F.lit("k &ndash; $180k"))
    plan = spark.range(150, 151).select(extract.salary(said).alias("s"))
    text_of = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text_of.count("cast(id") == 1
    # Of each pattern: the match and its two amounts; what unescaping takes comes on top.
    assert sum(text_of.count(f"(?i){p}") for p in V.SALARIES) <= 3 * len(V.SALARIES)
    assert [tuple(r.s or ()) for r in plan.collect()] == [()]  # near revenue


def test_each_salary_pattern_is_tried_where_its_words_are(spark):
    texts = ["PAY BAND: $90k - $120k", "Base Salary of $90,000 – $120,000", "$90,000 - $120,000 per ANNUM", "€90k—€120k", "£90,000 TO £120,000", "Compensation: $90,000 to $120,000", "$2 Billion sold for $9, $90k - $120k", "$3M ARR, $90k - $120k", "&#36;90k - $120k", "$90k", None]
    found = values(spark, [(t,) for t in texts], "t string", extract.salary(F.col("t")))
    sign = [None if f is None else f.currency for f in found]
    assert sign == ["USD", "USD", "USD", "EUR", "GBP", "USD", None, None, "USD", None, None]
    assert {(f.salary_min, f.salary_max) for f in found if f} == {(90_000.0, 120_000.0)}
    for p, words in zip(V.SALARIES + V.REVENUE, V.SALARY_WORDS + V.REVENUE_WORDS, strict=True):
        assert all(w in p for w in words)


@pytest.mark.parametrize("name", ["stream_retries", "stream_breakers", "stream_dedup", "stream_daily_counts", "stream_posted_once"])
def test_streams_over_files_that_overlap_in_time(spark, tmp_path, name):
    """A table of several files, each with rows of the whole time: no row is late."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    names = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {names} FROM ({catalog.SQL[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_a_task_holds_little_of_each_set_that_it_compares():
    """near_duplicate_pairs, cluster_survivors: of a tile of two shards, a few numbers a set besides its first words, and few pairs at a time."""
    rnd = np.random.default_rng(5)
    sets = [rnd.choice(4000, 100, replace=False) * 1_000_003 for _ in range(12_000)]
    for i in range(0, 400, 2):
        sets[i + 1] = np.concatenate([sets[i][:90], rnd.integers(5_000_000, 6_000_000, 10)])
    # Shards by turns, so that the pairs are across.
    given = pa.RecordBatch.from_pydict({"id": range(len(sets)), "block": ["x"] * len(sets), "only": pa.nulls(len(sets), pa.string()), "spread": [i * setjoin.SPREAD for i in range(len(sets))], "words": pa.array([x.astype(np.int32) for x in sets], pa.list_(pa.int32()))})
    dealt = pa.Table.from_batches(setjoin._dealer(np.zeros(1 << setjoin.COUNTED, np.int32), {("x", 0): 2}, 0.6)(iter([given])))
    rows = sorted((r for r in dealt.to_pylist() if r["place"] == 1 << 38), key=lambda r: r["n"])  # the tile of shards 0 and 1
    assert len(rows) == len(sets) and {r["side"] for r in rows} == {0, 1}
    marks = [np.array(r["marks"], np.int32) for r in rows]
    starts, n, side = np.cumsum([0] + [len(m) - 8 for m in marks]), np.array([r["n"] for r in rows]), np.array([r["side"] for r in rows])
    words, maps = np.concatenate([m[8:] for m in marks]), np.stack([m[:8] for m in marks]).view(np.uint64)
    tracemalloc.start()
    found = {tuple(sorted((rows[x]["id"], rows[y]["id"]))) for i, j in setjoin.alike(n, starts, words, maps, side, True, np.full(len(rows), True), 0.6) for x, y in zip(i, j, strict=True)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(i, i + 1) for i in range(0, 400, 2)}
    assert peak < 70_000_000


def test_shared_words_are_counted_a_few_partners_at_a_time(monkeypatch):
    monkeypatch.setattr(setjoin, "AT_ONCE", 50)
    rnd = random.Random(7)
    sets = [sorted(rnd.sample(range(90), rnd.randrange(1, 60))) for _ in range(40)]
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(40) if a != b]
    starts = np.cumsum([0, *map(len, sets)])
    got = setjoin._shared(np.concatenate(sets), starts, *(np.array(x) for x in zip(*pairs, strict=True)), 90)
    assert got.tolist() == [len(set(sets[a]) & set(sets[b])) for a, b in pairs]


def test_texts_that_no_pair_asks_for_stay_where_they_are(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("said "), F.col("id").cast("string")).alias("said"))
    ids = spark.createDataFrame([(i, t) for i in range(0, 20_000, 40) for t in (1, 2)], "id long, to int")
    kept = [r.id for r in setjoin._asked(rows, ids).collect()]
    assert set(kept) >= set(range(0, 20_000, 40)) and len(kept) == len(set(kept)) < 600
