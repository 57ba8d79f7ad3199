"""The registered queries and the pipeline on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from ternfield.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op13_prefix_trie"}))  # that one has a row a node
def test_one_row_a_document(spark, name):
    got = queries.QUERIES[name](spark, SF)
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    want = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(ids) == sorted(want)


def test_line_dedup_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES["op2_line_dedup"](spark, SF)
    want = c.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.ORACLE['op2_line_dedup']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count(), name
        docs = out
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept
