"""Line dedup, exact dedup, personal data, suffix dedup and near-dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import exact_dedup, line_dedup, minhash_dedup, pii, suffix_dedup
from spindrift.operators.components import components

SCHEMA = "doc_id long, text string, n_lines int, kept string, spans string, shard int, key string"
EDGE = [(None, "a null id", 1, "x", "y", 2, "z"), (1, None, 1, "x", "y", 2, "z"), (2, "", None, None, None, None, None), (3, "Same Text", 1, "x", "y", 2, "z"), (4, "same text", 1, "x", "y", 2, "z"), (4, "same text", 1, "x", "y", 2, "z"), (5, "long " * 30000, 1, "x", "y", 2, "z")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5)[:7] for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def edge(spark):
    return docs(spark, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(spark):
    rnd = random.Random(1)
    lines = [f"  Shared line number {i} with words \t" for i in range(6)] + ["short", ""]
    rows = [(i, "\n".join(rnd.choice(lines).upper() if rnd.random() < 0.3 else rnd.choice([*lines, f"own line {rnd.random()}"]) for _ in range(rnd.randint(0, 9)))) for i in range(40)]
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").lower()
    holders = defaultdict(set)
    for i, t in rows:
        for s in t.split("\n"):
            holders[key(s)].add(i)
    want = {}
    for i, t in rows:
        kept = [s for s in t.split("\n") if not (len(key(s)) >= 20 and len(holders[key(s)]) >= 3 and max(holders[key(s)]) != i)]
        want[i] = (len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()} == want


def test_lines_of_repeated_rows_count_once(spark):
    line = "a line of more than twenty characters"
    two = [(1, line), (1, line), (2, line)]
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.drop_repeated_lines(docs(spark, two)).collect()} == {(1, 0), (2, 0)}
    three = [*two, (3, f"{line}\nown"), (None, line), (None, line)]
    assert {(r.doc_id, r.n_dropped, r.kept_text) for r in line_dedup.drop_repeated_lines(docs(spark, three)).collect()} == {(1, 1, ""), (2, 1, ""), (None, 1, ""), (3, 0, f"{line}\nown")}


def test_line_dedup_edges(edge, empty):
    got = line_dedup.drop_repeated_lines(edge).collect()
    assert len(got) == len(EDGE) and {(r.n_lines, r.n_dropped) for r in got} == {(1, 0)}
    assert line_dedup.drop_repeated_lines(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filters_miss_nothing(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    built = exact_dedup.build_filter(keys)
    assert exact_dedup.probe_filter(keys, *built).all()
    others = exact_dedup.probe_filter(rng.integers(2**63, 2**64, 20_000, dtype=np.uint64), *built)
    assert others.mean() < 0.01
    assert n < 10_000 or len(built[3]) < 1.5 * n


def test_exact_dedup(spark, edge, empty):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["Aa b", "aA B", "ÄA", "äa", "", f"own {i}", None, "x" * 999])) for i in range(120)]
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    for per_bucket in (3, 1000):
        got = exact_dedup.exact_groups(*exact_dedup.halves(docs(spark, rows)), keys_per_bucket=per_bucket).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == {i: (max(groups[norm(t)]), len(groups[norm(t)]), i == max(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}
        assert len(got) == len(rows)
    got = exact_dedup.exact_groups(*exact_dedup.halves(edge)).collect()
    assert len(got) == len(EDGE) and {(r.doc_id, r.group_size, r.kept) for r in got if r.doc_id in (3, 4)} == {(3, 3, False), (4, 3, True)}
    assert exact_dedup.exact_groups(empty, empty).count() == 0


def test_a_batch_far_larger_than_its_snapshot(spark, monkeypatch):
    """One row far below the others is the whole snapshot; no group of the screen gets more digests than a bucket holds."""
    rows = [(0, "old"), *[(10**12 + i, f"own {i % 700}") for i in range(1500)], (10**12 + 1500, "OLD")]
    pandas_cogroup = type(spark.range(1).groupBy("id").cogroup(spark.range(1).groupBy("id")))
    apply = pandas_cogroup.applyInPandas
    monkeypatch.setattr(pandas_cogroup, "applyInPandas", lambda self, f, schema: apply(self, lambda batch, filters: f(batch, filters) if len(batch) <= 150 else 1 / 0, schema))
    got = exact_dedup.exact_groups(*exact_dedup.halves(docs(spark, rows)), keys_per_bucket=100).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t.lower()].append(i)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: (max(groups[t.lower()]), len(groups[t.lower()])) for i, t in rows}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def test_personal_data(spark, edge, empty):
    rnd = random.Random(5)
    texts = ["a@b.c%d@e.f x", "1.2.3.4.5.6.7.8", "999.1.1.1 4111 1111 1111 1111 é +44 20 7946 0958 x@y.zz", "", None, "x.y@z", "4111-1111-1111-1111-", "0001.2.3.4", "+ 1 2", "1 " * 9000, "a" * 30_000, "1." * 9000, "x@y.z é " * 3000]
    texts += ["".join(rnd.choice("0123456789.+@a-(  )é") for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in BASE] for r in pii.find_personal_data(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if confirmed(k, m[0])] for i, t in enumerate(texts)}
    more = ["iban DE89 3704 0044 0532 0130 00 here", "DE88 3704 0044 0532 0130 00", "my ssn 123-45-6789", "order 123-45-6789"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(docs(spark, list(enumerate(more)))).collect()}
    assert got == {0: [("iban", 5, 32)], 1: [], 2: [("ssn", 7, 18)], 3: []}
    near = ["social security of the departing clerk: 123-45-6789", "part 123-45-6789 ssn", "a ship 123-45-6789", "SSN: 123-45-6789"]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(docs(spark, list(enumerate(near)))).collect()}
    assert got == {0: ["ssn"], 1: [], 2: [], 3: ["ssn"]}
    text = F.col("text")
    red = docs(spark, [(0, "to a@b.cc, a@b.cc or 1.2.3.4."), (1, "none")]).select("doc_id", pii.redact(text, pii.span_column(text)).alias("x"))
    assert {r.doc_id: r.x for r in red.collect()} == {0: "to [EMAIL], [EMAIL] or [IP].", 1: "none"}
    assert pii.find_personal_data(edge).count() == len(EDGE) and pii.find_personal_data(empty).count() == 0


def test_deep_shallow_sorting():
    rnd = random.Random(2)
    for _ in range(60):
        texts = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 90))) for _ in range(rnd.randint(1, 30))]
        texts += [t[: rnd.randint(0, len(t))] for t in texts] + texts[:3] + [b"q" * 70 + t for t in texts]
        groups = np.sort(np.array([rnd.randint(0, 3) for _ in texts]))
        order, shared = suffix_dedup.deep_shallow(texts, groups)
        assert sorted(order.tolist()) == list(range(len(texts)))
        for i, k in enumerate(order.tolist()):
            before = order[i - 1]
            if i and groups[before] == groups[k]:
                assert texts[before] <= texts[k] and shared[i] == suffix_dedup.common_prefix(texts[before], texts[k])
            else:
                assert shared[i] == -1


def repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        covered = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                covered[s : s + 100] = True
            seen.add(data[s : s + 100])
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out[i] = (len(data), int(covered.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~covered]))
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 3, "shard_bytes": 3000}, {"hot": 10**9, "shard_bytes": 3000}])
def test_suffix_dedup(spark, limits):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(15, 60))) for _ in range(12)]
    rows = [(i * 7, "\n".join(" ".join(rnd.choice(words) + str(rnd.randint(0, 9999)) for _ in range(rnd.randint(0, 30))) if rnd.random() < 0.6 else rnd.choice(passages)[rnd.randint(0, 30) :] for _ in range(rnd.randint(0, 6)))) for i in range(100)]
    rows += [(2000, "=" * 400), (2001, "-=" * 300), (2002, ""), (2003, rows[3][1]), (2004, "x" * 99), (2005, "=" * 150), (2006, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs(spark, rows), **limits).collect()}
    assert got == repeats(rows)


def test_suffix_dedup_of_ids_over_all_64_bits(spark):
    rnd = random.Random(12)
    passage = " ".join(str(rnd.random()) for _ in range(20))
    for ids in ([-9 * 10**18, -1, 0, 9 * 10**18], [0, 10**12, 10**12 + 1, 10**12 + 2], [-(2**63), 2**63 - 1, 5, 6]):
        rows = [(i, f"{i} own {rnd.random()}\n{passage}") for i in ids]
        rnd.shuffle(rows)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs(spark, rows), shard_bytes=300).collect()}
        assert got == repeats(sorted(rows)) and sum(x[1] for x in got.values()) > 3 * len(passage) - 1


def test_suffix_dedup_edges(edge, empty):
    got = suffix_dedup.remove_repeats(edge).collect()
    assert len(got) == len(EDGE) and {(r.doc_id, r.n_removed) for r in got if r.doc_id != 5} == {(None, 0), (1, 0), (2, 0), (3, 0), (4, 0)}
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_probability_jaccard_and_its_estimate():
    rng, gaps = np.random.default_rng(0), []
    for _ in range(20):
        a = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 2**62, 200)}
        b = {x: (c if rng.random() < 0.8 else int(rng.integers(1, 4))) for x, c in a.items() if rng.random() < 0.9}
        sets = [(np.array(sorted(d), np.uint64), np.array([d[x] for x in sorted(d)])) for d in (a, b)]
        want = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())
        assert abs(want - minhash_dedup.probability_jaccard(*sets)) < 1e-9
        winners = minhash_dedup.signatures(sets)
        gaps.append((winners[0] == winners[1]).mean() - want)
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.06


@pytest.mark.parametrize("block", [4, 256])
def test_near_classes(spark, block):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(6):
        base = [rnd.choice(words) for _ in range(120)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows), " ".join(copy).title() if rnd.random() < 0.3 else "  ".join(copy)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "one two", "one  Two", "a a a a a a a"])]
    sets = minhash_dedup.shingles([t for _, t in rows])
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if minhash_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-12:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_classes(docs(spark, rows), block=block, code_block=4 * block).collect()}
    assert got == {i: root(i) for i in range(len(rows))}


def test_near_classes_of_shared_ids_and_chains(spark):
    """Contents that share an id stay apart, and classes are what verified links connect, band hits alone don't."""
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(200)]
    rows = [(1, " ".join(base)), (1, "some other words that share this id"), (2, " ".join([*base[:-3], "x", "y", "z"])), (9, "some other words that share this id")]
    # A family around 0.7: many band hits, few links.
    for i in range(60):
        copy = list(base)
        for k in range(0, 200, 25):
            copy[k + rnd.randint(0, 24)] = f"v{i}-{k}"
        rows.append((100 + i, " ".join(copy)))
    sets = minhash_dedup.shingles([t for _, t in rows])
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if minhash_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-12:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    for block in (5, 256):
        got = minhash_dedup.near_classes(docs(spark, rows), block=block, code_block=4 * block).withColumn("h", F.col("text_hash")).collect()
        hashes = {r[0]: h for r, h in zip(rows, [x[0] for x in spark.createDataFrame([(t,) for _, t in rows], "t string").select(F.xxhash64("t")).collect()])}
        assert len(got) == len(rows) and hashes
        want = sorted((r[0], rows[root(i)][0]) for i, r in enumerate(rows))
        assert sorted((r.doc_id, r.class_id) for r in got) == want
        assert sum(r.kept for r in got) == len({root(i) for i in range(len(rows))})


def test_near_classes_edges(edge, empty):
    got = minhash_dedup.near_classes(edge).collect()
    assert len(got) == len(EDGE) and {r.class_id for r in got if r.doc_id in (3, 4)} == {3}
    assert minhash_dedup.near_classes(empty).count() == 0


def test_components(spark):
    rnd = random.Random(9)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [(rnd.randint(300, 340), rnd.randint(300, 340)) for _ in range(25)] + [(None, 1), (5, 5)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(200, 240)} == {200}
    assert all(got[a] == got[b] <= min(a, b) for a, b in links if a and a != b)
