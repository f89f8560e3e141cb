"""The stages and registered queries on the smallest tables."""

import re

import pytest

import corpus_pipeline
from footprints.llm import pseudonyms, queries
from tests.check_queries import compare, connect
from tests.llm.plain import odd_rows, table
from tests.llm.test_dedup import plain_line_dedup, plain_links

FOLDER = "/root/testdata/sf0.001"


def test_stages_decide_as_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.language(spark, docs, FOLDER)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == columns and len(rows) > 0.95 * docs.count()
    lines = corpus_pipeline.lines(spark, kept, FOLDER)
    plain = plain_line_dedup(rows)
    want = {d: plain[d, t][2] for d, t in rows if plain[d, t][0] == 0 or plain[d, t][2].strip()}
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == columns and {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    near = corpus_pipeline.near_duplicates(spark, lines, FOLDER)
    class_of = plain_links(sorted(want.items()), 5, 8, 10)
    assert near.columns == columns and {r.doc_id for r in near.collect()} == set(class_of.values())
    private = corpus_pipeline.personal_data(spark, near, FOLDER)
    assert private.columns == columns
    for r in private.collect():
        assert r.text == pseudonyms.replaced(want[r.doc_id], pseudonyms.DEMONSTRATION_KEY)[0]
        assert not set(re.findall(r"\S+@\S+\.com", want[r.doc_id])) & set(re.findall(r"\S+@\S+\.com", r.text))
    packed = corpus_pipeline.pack(spark, private, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(class_of.values()) and all(r.padding == r.bound - r.n_tokens for r in packed if r.bucket >= 0)


def test_stages_take_odd_rows(spark):
    docs = table(spark, odd_rows()).selectExpr("*", "1 as row", "'x' as _kept", "2 as n_tokens")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert "_kept" in docs.columns
    assert corpus_pipeline.pack(spark, docs, FOLDER).count() == docs.count()
    empty = table(spark, odd_rows()).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    status, _, _, _, note = compare(spark, connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLES[name])
    assert status == "ok", note


