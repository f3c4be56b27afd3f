"""Token store, packing, SentencePiece codec, embeddings, quality and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import embedding_dedup, packing, piece_codec, quality, queries, token_store, word_ids

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, ids string, task int, start long"
EDGE = [(None, "a null id", "s", "x", 1, 1), (1, None, None, "x", 1, 1), (2, "", "", None, None, None), (3, "Same Text", "s", "x", 1, 1), (3, "Same Text", "s", "x", 1, 1), (4, "long words " * 20000, "s", "x", 1, 1), (5, "日本 Σας <|endoftext|> '''ll  ▁", "t", None, None, None)]


def encode(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    def load(name):
        t = Tokenizer.from_file(queries.tokenizer_path(name))
        return t

    return load


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_ids_equal_the_library(tokenizer, name):
    rnd, t = random.Random(1), tokenizer(name)
    texts = ["".join(rnd.choice("aBcé ß'sdtreÀÿ×÷0 9\n\t\r.,<|>endoftext-_~  ") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["it's I'LL don't 'S 's", "", "   ", " \n \n", "<|endoftext|> x", "Σας ΟΔΟΣ", " a\x1cb\x85c", "é ½ ² ª º µ", "x" * 5000, "a b ", " a b", "a\n b", "a \nb"]
    own = word_ids.encoder(queries.tokenizer_path(name))
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == encode(t, text), text


def test_store_round_trip(spark, tokenizer):
    t = tokenizer("word_bpe_49k.json")
    docs = spark.createDataFrame(EDGE, SCHEMA).repartition(3)
    store = token_store.write_store(docs, queries.tokenizer_path("word_bpe_49k.json"), 2)
    want = {}
    for i, text in {(r[0], r[1]) for r in EDGE}:
        want[i] = [*encode(t, text), 2]
    ids = token_store.read_ids(store, spark).collect()
    assert len(ids) == len(EDGE) and all(list(r.ids) == want[r.doc_id] for r in ids)
    rows = sorted(token_store.read_summaries(store, spark).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want[r.doc_id]), zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()))
        at += r.n_tokens
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 4, 5]
    chunks = store.chunks(spark)
    assert chunks.count() == chunks.select("digest").distinct().count()
    empty = token_store.write_store(spark.createDataFrame([], SCHEMA), queries.tokenizer_path("word_bpe_49k.json"), 2)
    assert token_store.read_summaries(empty, spark).count() == 0


def test_store_notices_damage(spark, tmp_path):
    store = token_store.write_store(spark.createDataFrame(EDGE, SCHEMA), queries.tokenizer_path("word_bpe_49k.json"), 2)
    broken = token_store.Store(str(tmp_path / "s"))
    for part in ("recipes", "manifest", "shards"):
        spark.read.parquet(f"{store.path}/{part}").write.parquet(f"{broken.path}/{part}")
    store.chunks(spark).limit(1).withColumnRenamed("digest", "key").write.parquet(f"{broken.path}/data/kind=chunk")
    with pytest.raises(Exception, match="missing"):
        token_store.read_summaries(broken, spark).collect()
    store.chunks(spark).withColumn("ids", F.concat("ids", "ids")).withColumnRenamed("digest", "key").write.mode("overwrite").parquet(f"{broken.path}/data/kind=chunk")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_summaries(broken, spark).collect()


@pytest.mark.parametrize(("column", "value"), [("doc_id", "doc_id + 100"), ("within", "7L"), ("ends", "transform(ends, e -> e + 1)"), ("n_tokens", "n_tokens + 1"), ("digests", "reverse(digests)"), ("place", "0L")])
def test_store_notices_changed_recipes(spark, tmp_path, column, value):
    store = token_store.write_store(spark.createDataFrame(EDGE, SCHEMA), queries.tokenizer_path("word_bpe_49k.json"), 2)
    changed = token_store.Store(str(tmp_path / "s"))
    for part in ("data", "manifest", "shards"):
        spark.read.parquet(f"{store.path}/{part}").write.parquet(f"{changed.path}/{part}")
    spark.read.parquet(f"{store.path}/recipes").withColumn(column, F.expr(value)).write.parquet(f"{changed.path}/recipes")
    with pytest.raises(Exception, match="disagree|missing"):
        token_store.read_summaries(changed, spark).collect()


def test_store_of_many_long_documents(spark, tokenizer):
    t, rnd = tokenizer("word_bpe_49k.json"), random.Random(8)
    passage = " ".join(f"w{rnd.randint(0, 999)}" for _ in range(900))
    rows = [(i, " ".join(rnd.choice([passage, f"x{rnd.randint(0, 99999)}"]) for _ in range(rnd.randint(0, 12))), None, None, None, None) for i in range(300)]
    store = token_store.write_store(spark.createDataFrame(rows, SCHEMA).repartition(7), queries.tokenizer_path("word_bpe_49k.json"), 2)
    at, got = 0, {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_summaries(store, spark).collect()}
    for i, text, *_ in rows:
        ids = [*encode(t, text), 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_crc_parts_make_the_whole():
    rng = np.random.default_rng(1)
    for _ in range(20):
        parts = [rng.bytes(int(rng.integers(0, 5000))) for _ in range(5)]
        after = np.array([sum(map(len, parts[i + 1 :])) for i in range(5)])
        moved = token_store.crc_shift(np.array([zlib.crc32(p) for p in parts]), after)
        assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(b"".join(parts))


def check_pieces(rows, want):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, held in sequences.items():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or k == max(sequences)


@pytest.mark.parametrize(("targets", "window"), [(None, 65536), (None, 2048), ({"a": 3, "b": 1}, 4096)])
def test_packing(spark, tokenizer, targets, window):
    rnd, t = random.Random(2), tokenizer("byte_bpe_50k.json")
    rows = [(i, " ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 400))), rnd.choice(["a", "a", "b", None]), None, None, None) for i in range(80)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), queries.tokenizer_path("byte_bpe_50k.json"), 0, targets=targets, window=window).collect()
    check_pieces(out, {r[0]: [*encode(t, r[1]), 0] for r in rows})
    totals = defaultdict(int)
    for r in out:
        totals[r.source] += r.length
    # Tokens of each window by source, counted in the pieces; sequences don't end where windows do only if the window is no multiple of them.
    given = defaultdict(lambda: defaultdict(int))
    for r in out:
        given[(r.sequence_id * 1024 + r.offset) // window][r.source] += r.length
    weights, left = targets or dict(totals), dict(totals)
    for k in range(len(given) - 1):
        active = {s: w for s, w in weights.items() if left[s] >= window}
        if len(active) == len(weights):
            for s, w in weights.items():
                assert abs(given[k][s] - window * w / sum(weights.values())) <= 4, (k, s)
        for s, n in given[k].items():
            left[s] -= n
    assert window > 4096 or len(given) > 2


def test_mixture_is_exact_and_bounded():
    rnd = random.Random(6)
    for targets in (None, {f"q{i}": rnd.random() * 10.0 ** -rnd.randint(0, 9) for i in range(40)}):
        mixture = packing.Mixture({f"q{i}": rnd.randint(0, 30_000) for i in range(60)}, targets, 4096)
        places = []
        for q, total in enumerate(mixture.totals):
            assert [mixture.given(q, k + 1) >= mixture.given(q, k) for k in range(mixture.n_windows)].count(False) == 0
            for done, n, place in mixture.pieces(q, 0, total) if total else ():
                places.append((place, n))
        at = 0
        for place, n in sorted(places):
            assert place == at
            at += n
        assert at == sum(mixture.totals)
    tiny = packing.Mixture({"a": 100_000, "b": 10**9}, {"a": 1e-8, "b": 1.0}, 4096)
    assert tiny.given(0, 244_100) == 9 and tiny.given(0, tiny.n_windows) == 100_000


def test_packing_of_many_sources(spark, tokenizer):
    t, path = tokenizer("byte_bpe_50k.json"), queries.tokenizer_path("byte_bpe_50k.json")
    rows = [(i, f"text {i} " * (1 + i % 7), f"s{i}" if i % 3 else "hot", None, None, None) for i in range(9000)]
    held, packing.LEAST_SHARE = packing.LEAST_SHARE, 64
    try:
        out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), path, 0).collect()
    finally:
        packing.LEAST_SHARE = held
    check_pieces(out, {r[0]: [*encode(t, r[1]), 0] for r in rows})


def test_packing_edges(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    out = packing.pack(spark.createDataFrame(EDGE, SCHEMA), path, 0).collect()
    assert sum(r.length for r in out if r.doc_id == 2) == 1 and len({r.doc_id for r in out}) == 6
    assert packing.pack(spark.createDataFrame([], SCHEMA), path, 0).count() == 0


def test_piece_codec(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model, own, rnd = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.encoder(path), random.Random(3)
    assert own.by_word
    for _ in range(2000):
        text = "".join(rnd.choice("ab é\n\t ▁①ß. the  ing<s>") for _ in range(rnd.randint(0, 40)))
        assert np.frombuffer(own.encode(text), "<i4").tolist() == model.encode(text), text
    docs = spark.createDataFrame(EDGE, SCHEMA)
    got = piece_codec.decode(piece_codec.encode(docs, path), path).collect()
    assert len(got) == len(EDGE)
    assert sorted((list(r.ids), r.text) for r in got) == sorted((model.encode(r[1] or ""), model.decode(model.encode(r[1] or ""))) for r in EDGE)
    assert piece_codec.encode(spark.createDataFrame([], SCHEMA), path).count() == 0


@pytest.mark.parametrize("dim", [2, 3, 16, 64, 384, 768])
def test_cross_polytope_recall(dim):
    """Pairs at a cosine of exactly 0.9, the hardest that count, for every number of joined hashes."""
    rng, n_pairs = np.random.default_rng(dim), 300
    a = rng.standard_normal((n_pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.standard_normal(a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * n
    for hashes in (1, 2, 3, 4):
        met = np.zeros(n_pairs, bool)
        placed = embedding_dedup.buckets(np.concatenate([a, b]), embedding_dedup.tables_of(hashes), hashes, embedding_dedup.PROBES)
        met |= (placed[:n_pairs, :, :, None] == placed[n_pairs:, :, None, :]).any((1, 2, 3))
        print(f"recall dim {dim} hashes {hashes}: {met.mean():.3f}")
        assert met.mean() >= 0.9, (dim, hashes)


def test_near_vectors_of_repeated_and_null_ids(spark):
    one, two = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.0]
    rows = [(7, one, 1), (7, two, 1), (8, [x * 2 for x in one], 1), (9, two, 1), (9, two, 1), (None, one, 1), (None, None, 1)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id int").withColumn("kept", F.lit("x"))).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted([(7, 1, 7, True), (7, 2, 7, True), (8, 1, 7, False), (9, 2, 7, False), (9, 2, 7, False), (None, 0, None, True), (None, 0, None, True)], key=str)


@pytest.mark.parametrize("size", [64, 1024])
def test_near_vectors(spark, size):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((150, 64))
    hot = rng.standard_normal(64)
    crowd = hot + 0.15 * rng.standard_normal((200, 64)) * np.linalg.norm(hot) / 8
    vectors = [v.tolist() for v in np.concatenate([a, a + 0.02, crowd, crowd[:40], crowd[:1].repeat(20, 0)])]
    vectors += [None, [0.0] * 64, [None] * 64, [float("nan")] * 64, [], [1.0] * 3, [2.0] * 3]
    unit = np.array([v if v and len(v) == 64 and None not in v else [0.0] * 64 for v in vectors])
    unit = np.nan_to_num(unit)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    links[-1, -2] = links[-2, -1] = True
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, bucket=size, block=size).collect()}
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert found.sum() >= 0.99 * links.sum() and (found <= links.sum(1)).all()
    assert all(got[i].kept == (got[i].component_id == i) for i in got) and got[300].component_id == 300 and got[545].component_id == 300
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def junk(rnd, words):
    kind = rnd.randrange(3)
    if kind == 0:
        return " | ".join(words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w + rnd.choice(["%%%", "&&&", "$$$"]) for w in words)


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(700):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 150))]
        poor = i % 4 == 0
        rows.append((i, junk(rnd, words) if poor else " ".join(words) + "."))
        labels.append((i, 0 if poor else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit_on(docs, marks)
    out = quality.score(docs.withColumn("held", quality.held_out(F.col("doc_id"))), model).where("held").collect()
    right = [(r.score >= quality.LEAST_SCORE) == (r.doc_id % 4 != 0) for r in out]
    assert len(right) > 80 and np.mean(right) > 0.97
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    odd = quality.score(spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x" * 2_000_000, 0.5)], "doc_id long, text string, score double"), model).collect()
    assert all(0 <= r.score <= 1 for r in odd) and odd[0].score == odd[1].score
    nothing = quality.fit_on(docs, marks.limit(0))
    assert quality.score_text(b"abc", nothing) == quality.score_text(b"", nothing) == 0.5


def plain_logit(text, w):
    """The network written out: every filter at every place, every chunk, no slices."""
    data = [b + 1 for b in text]
    data += [0] * (quality.WIDTH + -(-max(0, len(data) - quality.WIDTH) // quality.STEP) * quality.STEP - len(data))
    responses = np.array([np.concatenate([w["embed"][c] for c in data[at : at + quality.WIDTH]]) @ w["filters"] for at in range(0, len(data) - quality.WIDTH + 1, quality.STEP)])
    halves = [responses[at : at + quality.HALF] for at in range(0, len(responses), quality.HALF)]
    chunks = [np.concatenate(halves[i : i + 2]) for i in range(max(1, len(halves) - 1))]
    out = []
    for c in chunks:
        features = np.concatenate([c.max(axis=0), c.mean(axis=0), [len(c) / (2 * quality.HALF)]])
        out.append(np.maximum(features @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"][0])
    return max(out)


def test_scores_equal_the_network_written_out():
    model, rnd = quality.new_model(3), random.Random(3)
    for n in (0, 1, 9, 200, 700, 5000):
        text = rnd.randbytes(n)
        assert abs(quality.poor_logit(text, model) - plain_logit(text, model.weights)) < 1e-4


def test_gradient_equals_differences():
    model, rnd = quality.new_model(5), random.Random(5)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    text = bytes(rnd.randrange(97, 110) for _ in range(400))
    grad = {k: np.zeros(v.shape) for k, v in w.items()}
    quality._gradient(text, 1, 1.0, model.weights, grad)
    loss = lambda: float(np.log1p(np.exp(-plain_logit(text, w))))
    for name, at in [("b2", (0,)), ("w2", (3,)), ("b1", (4,)), ("w1", (5, 2)), ("w1", (40, 7)), ("filters", (9, 4)), ("filters", (30, 20)), ("embed", (100, 2)), ("embed", (105, 0))]:
        before, step = w[name][at], 1e-5
        w[name][at] = before + step
        high = loss()
        w[name][at] = before - step
        low = loss()
        w[name][at] = before
        assert abs((high - low) / (2 * step) - grad[name][at]) < 2e-3 * max(1, abs(grad[name][at])), name


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * (1 + i % 4), 0.5) for i in range(60)] + [(None, "x", None), (7, None, 1.0), (8, "", 1.0), (8, "", 1.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 7), (9, 1), (9, 1)], "doc_id long, quality int")
    model = quality.fit_on(docs.drop("score"), marks, per_label=10)
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == 64 and out.where("score between 0 and 1").count() == 64
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit_on(docs.limit(0).drop("score"), marks).weights.keys() == model.weights.keys()


def test_long_labelled_texts_are_sampled(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "b@d | ") * (3000 if i % 10 < 2 else 20)) for i in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    taken = []
    held, quality.fit = quality.fit, lambda texts, labels, odds: taken.extend(map(len, texts)) or quality.new_model()
    try:
        quality.fit_on(docs, marks)
        quality.fit_on(docs, marks, most_bytes=100_000)
    finally:
        quality.fit = held
    assert max(taken) > 20_000


def test_a_text_that_does_not_fit_costs_no_other(spark):
    """Whatever its place in the order of ids, a text over the half or between what is left and the half is skipped alone."""
    rows = [(i, "good words here " * 20 if i % 2 else "b@d | " * 40) for i in range(60)] + [(100 + i, ("x" * n)) for i, n in enumerate((70_000, 70_000, 49_900, 49_900))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    held, seen = quality.fit, []
    quality.fit = lambda texts, labels, odds: seen.extend(zip(labels, map(len, texts), strict=True)) or quality.new_model()
    try:
        quality.fit_on(docs, marks, most_bytes=100_000)
    finally:
        quality.fit = held
    free = [i for i, _ in rows[:60] if zlib.crc32(str(i).encode()) % 5]
    for label in (0, 1):
        sizes = [n for y, n in seen if y == label]
        assert max(sizes) <= 49_900 and sum(sizes) <= 50_000 and (len(sizes) >= sum(i % 2 == label for i in free) or 49_900 in sizes)
    assert len(seen) > 20


def test_chunks_cover_the_whole_text():
    model = quality.new_model()
    for n in (0, 1, 7, 8, 9, 255, 256, 600, 300_000, quality.SLICE + 3):
        text = bytes(i % 251 for i in range(n))
        codes = quality._codes(text)
        tops, sums = quality._pooled(codes, model.weights)
        whole = quality._responses(codes, model.weights)
        assert np.allclose(tops.max(axis=0), whole.max(axis=0), atol=1e-4) and np.allclose(sums.sum(axis=0), whole.sum(axis=0), rtol=1e-2, atol=0.5)
        assert len(codes) >= n


ODD = [(1, "A text of six whole words here", "en", "s", 5, "x"), (1, "A text of six whole words here", "en", "s", 5, "x"), (1, "a Text of six whole words here", "en", "t", 5, "x"), (1, "another text that shares an id with others", "en", "s", 5, "y"),
       (2, "A text of six whole words here", None, None, None, None), (None, "A text of six whole words here", "en", "s", 5, "x"), (None, "only under null ids these words", None, None, None, None), (None, "only under null ids these words", None, "s", None, None),
       (3, None, None, None, None, None), (4, "", "en", "s", 0, "x"), (5, "   ", "en", "s", 3, "x"), (6, "long words and more " * 9000, "en", "s", 1, "x"), (7, "write to a@b.cc now", "en", "s", 3, "x")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows_and_no_rows(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, spark.createDataFrame(ODD, COLUMNS).repartition(3), SMALL)
    assert stage == 4 or out.columns == corpus_pipeline.COLUMNS
    rows = [tuple(r) for r in out.collect()]
    texts = sorted(((r[0], r[1]) for r in rows), key=str)
    if name == "exact_dedup":
        want = {(2, ODD[4][1]), (1, ODD[3][1]), (None, ODD[6][1]), (4, ""), (5, "   "), (6, ODD[11][1]), (7, ODD[12][1])}
        assert set(texts) == want and len(texts) == len(want)
    elif name == "near_dedup":
        kept = [t for t in texts if t[0] == 1 and t[1].lower() == ODD[0][1].lower()]
        assert len(kept) == 1 and not [t for t in texts if t == (2, ODD[4][1])] and (1, ODD[3][1]) in texts and len([t for t in texts if t[1] == ODD[6][1]]) == 1
        assert {t[0] for t in texts} == {1, None, 3, 4, 5, 6, 7}
    elif name == "personal_data":
        assert len(rows) == len(ODD) and (7, "write to [EMAIL] now", "en", "s", 20) in rows and (3, None, None, None, None) in rows
    elif name == "packing":
        assert {r[0] for r in rows} == {r[0] for r in ODD}
    else:
        assert {r[:5] for r in rows} <= {r[:5] for r in ODD}
    assert run(spark, spark.createDataFrame([], COLUMNS), SMALL).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.materialise(stage(spark, step, SMALL), "test")
        assert step.columns == docs.columns
        rows = step.collect()
        assert {r.doc_id for r in rows} <= set(kept) and rows
        if name == "exact_dedup":
            texts = defaultdict(list)
            for r in kept.values():
                texts[r.text.lower() if r.text.isascii() else r.text].append(r.doc_id)
            assert {r.doc_id for r in rows} == {max(v) for v in texts.values()}
        if name == "personal_data":
            assert {r.doc_id for r in rows} == set(kept) and all("@" not in r.text or r.text == kept[r.doc_id].text for r in rows)
        kept = {r.doc_id: r for r in rows}
    out = corpus_pipeline.STAGES[-1][1](spark, step, SMALL).collect()
    assert {r.doc_id for r in out} == set(kept)
