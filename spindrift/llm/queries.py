"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import embedding_dedup, exact_dedup, filter_audit, line_dedup, minhash_dedup, packing, piece_codec, pii, quality, quality_rules, suffix_dedup, token_store, vector_codes
from spindrift.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.read_summaries(store, spark)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, with_ids=False)
    return pieces.drop("ids")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_classes(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(*exact_dedup.halves(table(spark, sf_dir, "documents")))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    decoded = piece_codec.decode(piece_codec.encode(table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [pii.count_kind(F.col("spans"), k.name).alias(f"n_{k.name}") for k in pii.KINDS if k.base]
    base = F.sha2(pii.span_list(pii.base_spans(F.col("spans"))), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.LEAST_SCORE).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_packing": op3_packing,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_piece_codec": op8_piece_codec,
        "op9_pii": op9_pii,
        "op10_quality": op10_quality,
        "op11_vector_codes": op11_vector_codes,
        "op12_compression_bands": op12_compression_bands,
        "op13_filter_audit": op13_filter_audit,
    }


LINE_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, s.pos, s.line, translate(trim(s.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS pos) s),
common AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, (c.key IS NOT NULL AND l.doc_id <> c.last_doc) AS dropped FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EXACT_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def _vector_sql() -> str:
    """Four rounds over codebooks as rows (position, entry, x), then the codes."""
    rounds, book = [], "seeds"
    for i in range(1, 6):
        rounds.append(f"""near{i} AS MATERIALIZED (SELECT position, row, min(struct_pack(d := d, entry := entry)) AS best FROM (SELECT p.position, p.row, b.entry,
  list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN {book} b USING (position)) GROUP BY ALL)""")
        if i < 5:
            rounds.append(f"""mean{i} AS (SELECT position, entry, list(c ORDER BY place) AS x FROM (SELECT p.position, n.best.entry AS entry, u.place, floor(sum(u.c)::DOUBLE / count(*))::BIGINT AS c
  FROM parts p JOIN near{i} n USING (position, row), LATERAL (SELECT unnest(p.x) AS c, generate_subscripts(p.x, 1) AS place) u GROUP BY ALL) GROUP BY ALL)""")
            rounds.append(f"book{i} AS MATERIALIZED (SELECT b.position, b.entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN mean{i} m USING (position, entry))")
            book = f"book{i}"
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p AS position, list_slice(x, p * len(x) // 4 + 1, (p + 1) * len(x) // 4) AS x FROM v, range(4) t(p)),
seeds AS MATERIALIZED (SELECT position, row AS entry, x FROM parts WHERE row < 256),
{", ".join(rounds)},
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM {book}),
coded AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY position) AS code, sum(best.d)::BIGINT AS error FROM near5 GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (row), books
"""


AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 2 * length(x))::INTEGER
  + 8 * regexp_matches(x, '[#$%&*|]')::INTEGER + 16 * (doc_id > first)::INTEGER AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM t LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, s AS step, list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INTEGER AS earlier, 1 << (ascii(filter_order[s]) - 65) AS own FROM orders, range(1, 6) r(s)),
found AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE mask & (coalesce(earlier, 0) | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & coalesce(earlier, 0) = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & coalesce(earlier, 0) <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & coalesce(earlier, 0) = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & coalesce(earlier, 0) = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": LINE_SQL, "op7_exact_dedup": EXACT_SQL, "op11_vector_codes": _vector_sql(), "op13_filter_audit": AUDIT_SQL}
