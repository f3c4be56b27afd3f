"""The inverted-file index against brute force, its reads, and the embedding of rows that lack a vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators.vectorindex import VectorIndex, describe, embed_missing, reopen, search_many
from spindrift.scratch import scratch_path


def clustered(n, dims=16, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    return {i: (centres[i % groups] + 0.25 * rng.standard_normal(dims)).astype(np.float32) for i in range(n)}


def brute(vectors, query, k, but=None):
    unit = {i: v.astype(float) / np.linalg.norm(v.astype(float)) for i, v in vectors.items()}
    q = np.asarray(query, float) / np.linalg.norm(np.asarray(query, float))
    return sorted(((i, round(float(u @ q), 6)) for i, u in unit.items() if i != but), key=lambda x: (-x[1], x[0]))[:k]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist(), "c") for i, v in vectors.items()], "vec_id long, embedding array<float>, cell string").repartition(3)


@pytest.fixture(scope="module")
def built(spark):
    vectors = clustered(1200)
    return vectors, VectorIndex.build(frame(spark, vectors), "vec_id", "embedding", 16, scratch_path(spark, "vectors"), cells=12)


def same(got, want):
    return [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=2e-6)


def test_one_query_reads_few_cells_and_is_exact(spark, built, monkeypatch):
    vectors, index = built
    read, members = [], VectorIndex.members
    monkeypatch.setattr(VectorIndex, "members", lambda self, spark, cells=None: read.append(cells) or members(self, spark, cells))
    for at in (0, 5, 11):
        assert same(index.top(spark, vectors[at].tolist(), 10, probes=1), brute(vectors, vectors[at], 10))
    share = np.mean([sum(map(len, read)) / 3 / len(index.centroids)])
    assert share <= 0.5
    files = index.members(spark, read[0]).inputFiles()
    assert {int(f.split("cell=")[1].split("/")[0]) for f in files} == set(read[0])


@pytest.mark.parametrize("probes", [1, 3])
def test_many_queries_against_all_rows(spark, built, probes):
    vectors, index = built
    asked = {i: v for i, v in vectors.items() if i % 100 == 0}
    rows = search_many(frame(spark, asked), index, "vec_id", "embedding", 7, probes=probes, cells=True).collect()
    for i, v in asked.items():
        got = sorted(((r.id, r.similarity) for r in rows if r["query"] == i), key=lambda x: (-x[1], x[0]))
        assert same(got, brute(vectors, v, 7, but=i))
    assert np.mean([r.cells for r in rows]) < len(index.centroids) / 2


def test_copies_in_one_cell_are_dealt_over_blocks(spark, monkeypatch):
    from spindrift.operators import vectorindex

    monkeypatch.setattr(vectorindex, "BLOCK", 50)
    vectors = clustered(200) | {1000 + i: np.ones(16, np.float32) for i in range(300)}
    index = VectorIndex.build(frame(spark, vectors), "vec_id", "embedding", 16, scratch_path(spark, "vectors"), cells=6)
    asked = {i: vectors[i] for i in (3, 1000, 1299)}
    rows = search_many(frame(spark, asked), index, "vec_id", "embedding", 5).collect()
    assert sorted(r.id for r in rows if r["query"] == 1299) == [1000, 1001, 1002, 1003, 1004] and sorted(r.id for r in rows if r["query"] == 1000) == [1001, 1002, 1003, 1004, 1005]
    assert same(sorted(((r.id, r.similarity) for r in rows if r["query"] == 3), key=lambda x: (-x[1], x[0])), brute(vectors, vectors[3], 5, but=3))


def test_vectors_added_later_are_found(spark, built):
    vectors, _ = built
    index = VectorIndex.build(frame(spark, vectors), "vec_id", "embedding", 16, scratch_path(spark, "vectors"), cells=12)
    more = {5000 + i: v for i, v in clustered(40, seed=9).items()}
    index = reopen(describe(index.add(frame(spark, more), "vec_id", "embedding")))
    assert same(index.top(spark, more[5003].tolist(), 12), brute(vectors | more, more[5003], 12))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [2.0, 0.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(odd, "vec_id", "embedding", 2, scratch_path(spark, "vectors"), cells=4)
    assert index.counts.sum() == 2 and index.top(spark, [1.0, 0.0], 5) == [(1, 1.0), (6, 1.0)] and index.top(spark, [0.0, 0.0], 5) == []
    assert sorted((r["query"], r.id) for r in search_many(odd, index, "vec_id", "embedding", 5).collect()) == [(1, 6), (6, 1)]
    none = VectorIndex.build(odd.where("vec_id > 100"), "vec_id", "embedding", 2, scratch_path(spark, "vectors"))
    assert none.top(spark, [1.0, 0.0], 5) == [] and search_many(odd, none, "vec_id", "embedding", 5).count() == 0


def test_rows_without_a_vector_are_embedded_once(spark):
    jobs = spark.createDataFrame([(i, None if i == 3 else f"text {i}", i) for i in range(10)], "id long, text string, seen int").repartition(2)

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    held = spark.createDataFrame([(0,), (9,)], "id long")
    first = embed_missing(jobs, held, "id", "text", "seen", load, "lengths", most=4)
    assert sorted(r.id for r in first.collect()) == [5, 6, 7, 8]
    rest = embed_missing(jobs, held.unionByName(first.select("id")), "id", "text", "seen", load, "lengths", most=None)
    assert {r.id: r.vector for r in rest.collect()} == {i: [0.0 if i == 3 else 6.0, 1.0] for i in (1, 2, 3, 4)}
    assert embed_missing(jobs, jobs.select("id"), "id", "text", "seen", load, "lengths").agg(F.count("*")).first()[0] == 0
