"""The registered queries against SQL, and the pipeline stage by stage."""

import os
import sys

import pytest
from test_operators import AWKWARD, make

import corpus_pipeline
from loomshelf.llm import queries
from loomshelf.llm.common import settle

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
from check import compare  # noqa: E402

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, sf, con, name):
    _, problems = compare(queries.QUERIES[name](spark, sf), con, queries.SQL[name])
    assert not problems


COLUMNS = {
    "op2_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op3_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op4_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_quality": {"doc_id", "perplexity", "threshold", "kept"},
    "op6_simhash": {"doc_id", "fingerprint", "component_id"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_for_each_row_of_the_table(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    table = spark.read.parquet(f"{sf}/{'pages' if name == 'op3_warc' else 'documents'}.parquet")
    assert COLUMNS[name] <= set(got.columns) and got.count() == table.count()


def test_leaks_name_real_pairs(spark, sf):
    got = queries.QUERIES["op8_decontaminate"](spark, sf)
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    exact = {(d.doc_id, b.item_id) for b in items.itertuples() for d in docs.itertuples() if b.text and b.text in (d.text or "")}
    assert exact <= {(r.doc_id, r.item_id) for r in got.collect()}


def test_each_stage_keeps_the_columns_and_only_drops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == n and "token_ids" in last.columns


def test_stages_take_awkward_and_empty_tables(spark, sf):
    for docs in (make(spark, AWKWARD), make(spark, AWKWARD).where("doc_id < 0")):
        for name, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, sf), name)
