"""Plans reach the scan with pruned columns and pushed filters, and stay free of row-wise Python and of Cartesian products."""

import os
import re

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plan(spark, name):
    from siftline.plans.catalog import queries

    df = queries()[name](spark, DIR)
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text, table_column):
    return [m for m in re.findall(r"ReadSchema: struct<([^>]*(?:<[^>]*>[^>]*)*)>", text) if table_column in m]


def test_columns_are_pruned(spark):
    text = plan(spark, "jn1_chunk_document")
    chunk = read_columns(text, "document_id")
    assert chunk and all("text:" not in c and "token_count" not in c for c in chunk)
    assert all("embedding" not in c for c in read_columns(plan(spark, "src12_canonical_scan"), "chunk_id"))


def test_filters_are_pushed(spark):
    assert "EqualTo(is_duplicate_of," in plan(spark, "src12_canonical_scan")
    assert "EqualTo(event_type,purchase)" in plan(spark, "flt6_run_kind")


@pytest.mark.parametrize("name", ["prj1_normalise", "tok1_token_count", "fn5_pii_mask", "rnk1_weighted_rrf", "kg6_merge_entities", "jn10_span_overlap", "agg12_tfidf_labels", "grd1_input_guards"])
def test_no_python_and_no_products(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "CartesianProduct" not in text and "MapInPandas" not in text


def test_ranks_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "agg12_tfidf_labels")
