"""Registered queries against DuckDB, and the pipeline against its parts."""

import hashlib

import pytest

import corpus_pipeline
from knockon.llm import queries
from tests.llm.helpers import EDGE_ROWS, docs
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_exact_dedup import low
from tests.llm.test_pii import PATTERNS
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_simhash import brute_components, brute_print, near
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_duckdb(spark, name):
    ok, message = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, message


CONTRACT = {
    "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op2_simhash_near_dedup": "doc_id fingerprint component_id",
    "op3_toxicity": "doc_id held_out score predicted",
    "op6_benchmark_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8_url_filter": "page_id host path rule verdict",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op13_repeated_passages": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(CONTRACT[name].split()) <= set(got.columns)
    table = "pages" if "page_id" in got.columns else "documents"
    assert len(got.collect()) == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pii_digest_of_the_documents_matches_the_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op7_pii(spark, SF).collect():
        spans = [(k, *s) for k in PATTERNS for s in brute_spans(texts[r.doc_id], k)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans == joined


def test_near_dedup_of_the_documents_matches_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    parts = brute_components(sorted(set(prints.values())), near(2))
    least = {}
    for i, p in prints.items():
        least[parts[p]] = min(i, least.get(parts[p], i))
    got = queries.op2_simhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{p:016x}", least[parts[p]]) for i, p in prints.items()}


def test_pipeline_matches_brute_force(spark):
    kept = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {i: r for i, r in kept.items() if r.text and any(c.isalpha() for c in r.text)}
    last = {}
    for i, r in kept.items():
        last[low(r.text)] = max(i, last.get(low(r.text), i))
    kept = {i: r for i, r in kept.items() if last[low(r.text)] == i}
    prints = {i: brute_print(r.text) for i, r in kept.items()}
    parts = brute_components(sorted(set(prints.values())), near(2))
    first = {}
    for i in sorted(kept):
        first.setdefault(parts[prints[i]], i)
    kept = {i: kept[i] for i in first.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for i, r in kept.items():
        n, hit, _ = brute_hits(r.text, items)
        if not (hit > 0 and 20 * hit >= n):
            clean.add(i)
    docs_now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs_now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        from knockon.llm.common import shared_table
        docs_now = shared_table(stage(spark, docs_now, SF), "test-stage")
        assert docs_now.columns == columns
    assert {r.doc_id for r in docs_now.collect()} == clean
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == columns + ["mix_weight", "mix_copies"]
    drawn = out.collect()
    assert {r.doc_id for r in drawn} <= clean and len(drawn) == len({r.doc_id for r in drawn})
    total = sum(len((kept[i].text or "").split()) for i in clean)
    used = sum(r.mix_copies * len(r.text.split()) for r in drawn)
    assert 0.95 * total < used <= total


def test_pipeline_stages_take_edge_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        for rows in (EDGE_ROWS, []):
            assert stage(spark, docs(spark, rows, clash=True), SF).count() <= len(rows)
