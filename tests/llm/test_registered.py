"""The registered queries over a whole given table, against the libraries, brute force or their own SQL."""

import hashlib
import re
import zlib
from itertools import groupby

import duckdb
import numpy as np
import pytest

from spindrift.llm import queries
from test_text_operators import BASE, confirmed, repeats

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    def load(name, end):
        tokenizer = Tokenizer.from_file(queries.tokenizer_path(name))
        return lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, end]

    return load


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_op1(spark, texts, encode):
    tokens, at, want = encode("word_bpe_49k.json", 2), 0, {}
    for i in sorted(texts):
        ids = tokens(texts[i])
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_store(spark, SMALL).collect()} == want


def test_op2(spark, texts):
    want = {i: (n, removed, spans, hashlib.sha256(kept).hexdigest()) for i, (n, removed, spans, kept) in repeats(sorted(texts.items())).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_dedup(spark, SMALL).collect()} == want


def test_op3(spark, texts, encode):
    tokens = encode("byte_bpe_50k.json", 0)
    rows = queries.op3_packing(spark, SMALL).collect()
    for i, pieces in groupby(sorted(rows, key=lambda r: (r.doc_id, r.start)), lambda r: r.doc_id):
        ids, at = tokens(texts[i]), 0
        for p in pieces:
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    assert {r.doc_id for r in rows} == texts.keys()
    fills = []
    for _, pieces in groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        fills.append(at)
    assert max(fills) <= 1024 and sum(f < 1024 for f in fills) <= 1


def test_op4(spark):
    rows = sorted((r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect())
    unit = np.array([v / np.linalg.norm(v) for _, v in rows])
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    component = np.arange(len(rows))
    for _ in range(len(rows)):
        least = np.array([min(component[i], *component[near[i]]) if near[i].any() else component[i] for i in range(len(rows))])
        if (least == component).all():
            break
        component = least
    ids = [i for i, _ in rows]
    want = {ids[k]: (int(near[k].sum()), ids[component[k]], component[k] == k) for k in range(len(rows))}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op4_embedding_dedup(spark, SMALL).collect()} == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = queries.queries()[name](spark, SMALL).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)


def test_op8(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {i: (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))) for i, text in texts.items() for ids in [model.encode(text)]}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op8_piece_codec(spark, SMALL).collect()} == want


def test_op9(spark, texts):
    for r in queries.op9_pii(spark, SMALL).collect():
        base = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, texts[r.doc_id]) if confirmed(k, m[0])]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_op10(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op10_quality(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    judged = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    good, poor = [s for s, y in judged if y == 1], [s for s, y in judged if y == 0]
    assert np.mean([(g > p) + (g == p) / 2 for g in good for p in poor]) > 0.9
