import corpus_pipeline
from spindrift.llm import pii

GERMAN, SPACED, BRITISH, NORSE = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947"
MALTESE = "MT84MALT011000012345MTLCAST001S"
CASES = [
    (f"{GERMAN} Thanks", [GERMAN]),
    (f"pay {SPACED} Bank", [SPACED]),
    (f"{BRITISH} BIC DEUTDEFF", [BRITISH]),
    (f"{SPACED} 2024 it was", [SPACED]),
    (f"{GERMAN} 17", [GERMAN]),
    (f"{NORSE} A 1 B 2 C", [NORSE]),
    (f"{BRITISH} {GERMAN} {SPACED} {NORSE} OK", [BRITISH, GERMAN, SPACED, NORSE]),
    (f"{MALTESE} AND MORE", [MALTESE]),
    (f"NO12 345 {SPACED} Bank", [SPACED]),  # what seems to start before it ends within it
    (f"\U0001f600 {GERMAN}, {BRITISH}.", [GERMAN, BRITISH]),
    (f"{GERMAN}X Bank", []),
    (f"A{GERMAN} Bank", []),
    ("DE88 3704 0044 0532 0130 00 Bank", []),
    ("DE89 3704 0044 Bank", []),
]


def test_account_numbers_before_any_word(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, (t, _) in enumerate(CASES)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in pii.find_personal_data(docs).collect()}
    assert got == {i: found for i, (_, found) in enumerate(CASES)}
    red = {r.doc_id: r.text for r in corpus_pipeline.redact(spark, docs, "").collect()}
    assert red[0] == "[IBAN] Thanks" and red[1] == "pay [IBAN] Bank" and red[2] == "[IBAN] BIC DEUTDEFF"


def test_long_runs_stay_linear(spark):
    rows = [(0, "AB12 " * 20_000), (1, "DE89 3704 " * 10_000), (2, f"{GERMAN} " * 1_000)]
    got = {r.doc_id: r.n for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.count_kind(pii.F.col("spans"), "iban").alias("n")).collect()}
    assert got[2] == 1_000
