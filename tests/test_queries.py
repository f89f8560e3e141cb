"""Registered queries against their SQL on the smallest tables. FOOTPRINTS_ALL=1 runs every query."""

import os

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUICK = ["A20_gene_read_counts", "A8_rrna_coverage", "F9_A1_length_histogram", "J7_mark_nearby", "J14_combine_ends", "A24_pause_scores", "W2_smooth_with_edges", "O9_pairwise_samples", "S6_sam_round_trip"]
NAMES = list(entry.oracle_sql()) if os.environ.get("FOOTPRINTS_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    status, rows, _, _, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["sample", "gene", "rpkm"] and df.count() > 0
