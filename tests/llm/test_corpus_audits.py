"""Vector codes, quality rules and the filter audit against brute force, on odd rows and on the given tables."""

import base64
import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from spindrift.llm import filter_audit, quality_rules, vector_codes
from spindrift.llm.queries import op11_vector_codes, op12_compression_bands, op13_filter_audit

SMALL = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


# Vector codes


def lloyd(rows):
    """(codes, errors, codebooks) of integer vectors in order of their ids, by the plain definition."""
    x = np.array([v for _, v in rows], np.int64).reshape(len(rows), 4, -1)
    books = [x[:256, p].copy() for p in range(4)]

    def assign(p):
        d = ((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(4):
        for p, entries in enumerate([assign(p)[0] for p in range(4)]):
            for e in set(entries.tolist()):
                mine = x[entries == e, p]
                books[p][e] = [math.floor(int(s) / len(mine)) for s in mine.sum(axis=0)]
    last = [assign(p) for p in range(4)]
    return ["".join(f"{last[p][0][i]:02x}" for p in range(4)) for i in range(len(rows))], np.sum([d for _, d in last], axis=0).tolist(), np.array(books)


def test_vector_codes_against_plain_rounds(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 16))
    vectors = [(i, (centres[i % 5] + 0.3 * rng.standard_normal(16)).astype(float).tolist(), int(i % 3)) for i in range(900)]
    vectors = [(i, vectors[0][1] if i % 3 == 0 else v, y) for i, v, y in vectors]  # a vector that a third of the rows hold
    coded, books = vector_codes.compress(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"))
    got = {r.vec_id: r for r in coded.collect()}
    codes, errors, want = lloyd([(i, [math.floor(1024 * x) for x in np.array(v, np.float32).astype(float)]) for i, v, _ in vectors])
    assert np.array_equal(books, want)
    assert [got[i].code for i in range(900)] == codes and [got[i].error for i in range(900)] == errors
    by_label = Counter()
    for i, _, y in vectors:
        by_label[y] += errors[i]
    assert all(got[i].label_error == by_label[y] for i, _, y in vectors)


def test_vector_codes_of_odd_rows(spark):
    rows = [(5, [0.5, None, 1.0, 2.0], 1), (4, None, 1), (3, [float("nan"), 0.0, 0.0, 0.0], 1), (2, [float("inf"), 0.0, 0.0, 0.0], 1), (1, [0.1, -0.1, 0.0, 3e38], None), (1, [0.1, -0.1, 0.0, 3e38], None), (None, [-0.0001, 0.0, 0.0], 7), (0, [], None)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, v string, code string")
    coded, books = vector_codes.compress(frame)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in coded.collect())
    # Equal parts share the lower entry; 3e38 is held to the largest integer, a short vector is padded with zeros.
    assert got == [(False, 0, "00000000", 0, 0), (False, 1, "01010001", 0, 0), (False, 1, "01010001", 0, 0), (True, 0, "03000000", 0, 0)]
    assert books.shape == (4, 4, 1) and books[3].ravel().tolist() == [0, 1 << 25, 1 << 25, 0] and books[0].ravel().tolist() == [0, 102, 102, -1]
    empty, none = vector_codes.compress(frame.where("vec_id > 100"))
    assert empty.count() == 0 and none.size == 0


def test_distances_are_exact_at_the_largest_values():
    top = vector_codes.LARGEST
    parts, book = np.array([[top] * 16, [-top] * 16]), np.array([[-top] * 16, [top - 1] * 16])
    assert vector_codes.distances(parts, book).tolist() == [[(2 * top) ** 2 * 16, 16], [0, (2 * top - 1) ** 2 * 16]]


def test_members_stay_with_their_owner(spark):
    """Owner sums need no exchange of members: the only one merges the salts of an entry."""
    store = vector_codes._Members(spark)
    parts = spark.range(100).selectExpr("cast(id % 4 AS int) AS position", "cast(id % 7 AS int) AS next", "cast(id % 8 AS int) AS salt", "array(cast(id AS int)) AS part")
    members = store.migrate(parts)
    plan = vector_codes.owner_sums(members, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    store.drop()
    assert not store.tables


# Quality rules


def counts(text):
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def found(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]


def test_counts_against_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "b", "é ", " ", "\n", "\x1c", "\x85", "c#", "\r", "日 "]) for _ in range(rng.randint(0, 200)))
        assert found(quality_rules.judge(text.encode())) == counts(text)


def test_counts_over_cuts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(quality_rules, "PART", 50)
    rng = random.Random(6)
    text = " ".join(rng.choice(["one", "two", "three", "x" * 70]) for _ in range(400))
    assert found(quality_rules.judge(text.encode())) == counts(text)


def test_windows_stay_apart_beyond_62_bits():
    rng = random.Random(7)
    words = [str(i) for i in range(9000)]  # 9,000 words to the fifth pass 62 bits
    rng.shuffle(words)
    assert quality_rules.repeated_words(" ".join(words).encode()) == (9000, 0)
    assert quality_rules.repeated_words(" ".join(words + words[100:106]).encode()) == (9006, 12)


def prose(rng, n):
    stems = ["".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    return " ".join(rng.choice(stems) for _ in range(n))


def test_bands_judge_by_length():
    rng = random.Random(8)
    kept = lambda t: quality_rules.judge(t.encode())["kept"]
    assert all(kept(prose(rng, n)) for n in (12, 40, 200, 1000, 8000))
    noise = lambda n: " ".join(base64.b85encode(rng.randbytes(12)).decode() for _ in range(n))
    assert not kept(noise(400)) and not kept(noise(5000)) and kept(noise(4) + " " + prose(rng, 200))
    numbered = "\n".join(f"[{i:06d}] beat at {i:06d} from node {i * 3:06d}" for i in range(400))
    r = quality_rules.judge(numbered.encode())
    assert not r["base_failed"] and not r["kept"] and r["n_low_chunks"] == r["n_chunks"]


def test_a_stretch_fails_a_whole_within_its_band():
    rng = random.Random(9)
    numbered = "\n".join(f"[{i:06d}] beat at {i:06d} from node {i * 3:06d}" for i in range(160))
    fresh = " ".join("".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 8))) for _ in range(1500))
    r = quality_rules.judge((fresh + "\n" + numbered).encode())
    assert quality_rules._side(10_000, r["ratio"], quality_rules.Limits()) == 0 and not r["base_failed"]
    assert 4 * r["n_low_chunks"] > r["n_chunks"] and not r["kept"]


def test_rules_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "word"), (4, "a b c d e f g h i j k"), (4, "a b c d e f g h i j k"), (5, "x " * 500_000)]
    frame = spark.createDataFrame([(*r, "c", 1.0) for r in rows], "doc_id long, text string, kept string, ratio double")
    got = [(r.doc_id, r.n_words, r.n_dup_lines, r.base_failed, r.kept) for r in quality_rules.apply_rules(frame).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, True, False), (2, 0, 0, True, False), (3, 0, 0, True, False), (None, 1, 0, True, False), (4, 11, 0, False, True), (4, 11, 0, False, True), (5, 500_000, 0, True, False)], key=str)
    assert quality_rules.apply_rules(frame.where("doc_id > 10")).count() == 0


def test_registered_rules_on_a_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    rows = op12_compression_bands(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeats = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeats, n < 10 or 100 * repeats > 20 * n)
        assert r.kept is (not r.base_failed) if r.doc_id in good else r.kept <= (not r.base_failed)


# Filter audit


def plain_audit(docs, labels):
    """All rows from the definitions: every order applied filter by filter to the documents themselves."""
    smallest = {}
    for d, text, _ in docs:
        if d is not None:
            smallest[text or ""] = min(smallest.get(text or "", d), d)
    parts = {}
    for d, text, source in docs:
        t = text or ""
        words = re.findall(WORD, t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and smallest[t] < d}
        parts.setdefault(source or "", []).append((frozenset(f for f in "ABCDE" if fails[f]), any(x[0] == d and x[1] == 1 for x in labels if d is not None), any(x[0] == d and x[2] == 1 for x in labels if d is not None)))
    out = []
    for part, rows in parts.items():
        totals, steps = Counter(), []
        for order in permutations("ABCDE"):
            left, gone = rows, []
            for i, f in enumerate(order):
                hit = [r for r in left if f in r[0]]
                steps.append([part, "".join(order), i + 1, len(left) - len(hit), len(hit), sum(f in r[0] for r in gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in hit), sum(r[2] for r in hit)])
                totals[f] += len(hit)
                left, gone = [r for r in left if f not in r[0]], gone + hit
        out += [tuple([*s, totals[s[1][s[2] - 1]]]) for s in steps]
    return sorted(out)


def as_rows(frame):
    return sorted(tuple(r) for r in frame.select([f.split()[0] for f in filter_audit.SCHEMA.split(", ")]).collect())


def test_audit_on_odd_rows(spark):
    long = " ".join(map(str, range(250)))
    docs = [(1, None, None), (2, "", "a"), (3, long, "a"), (7, long, None), (7, long, "a"), (9, long + " #", "b"), (None, long, "b"), (None, "alone", "b"), (4, "SHOUT " * 210, "a"), (4, "SHOUT " * 210, "a"), (5, "SHOUT " * 210, "a"), (6, "é" * 98 + "AB", "a")]
    labels = [(3, 1, 0), (3, 0, 1), (7, 1, None), (None, 1, 1), (4, None, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*r, "m", 1) for r in docs], "doc_id long, text string, source string, mask string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert as_rows(filter_audit.audit(frame, marks)) == plain_audit(docs, labels)
    assert filter_audit.audit(frame.where("doc_id > 100"), marks).count() == 0
    assert as_rows(filter_audit.audit(frame, marks.where("doc_id > 1000"))) == plain_audit(docs, [])


def test_walk_visits_every_subset():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 9, (3, 32, 3))
    states = filter_audit.subset_states(cells)
    for subset in range(32):
        alive = [m for m in range(32) if m & subset == 0]
        assert np.array_equal(states[subset], cells[:, alive].sum(axis=1))


def test_copies_do_not_meet_in_a_window(spark):
    docs = spark.createDataFrame([(i, "same text", f"s{i % 3}") for i in range(500)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = {(r.part, r["mask"]): r.n for r in filter_audit.failure_masks(docs, labels).collect()}
    assert cells == {("s0", 1): 1, ("s0", 17): 166, ("s1", 17): 167, ("s2", 17): 166}
    assert "Window" not in filter_audit.failure_masks(docs, labels)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sf", [SMALL])
def test_registered_audit_on_a_whole_table(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert as_rows(op13_filter_audit(spark, sf)) == plain_audit(docs, labels)


def test_registered_codes_on_a_whole_table(spark):
    rows = sorted((r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect())
    codes, errors, books = lloyd(rows)
    got = {r.vec_id: r for r in op11_vector_codes(spark, SMALL).collect()}
    assert [(got[i].code, got[i].error) for i, _ in rows] == list(zip(codes, errors, strict=True))
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()}
