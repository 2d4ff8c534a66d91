"""Registered queries against DuckDB on the smallest tables, one per family of operators."""

import os

import pytest

from shelfspark.plans import ORACLE, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "c2_norm_code_unicode", "c14_parse_locale_float", "c20_primary_link", "c25_extract_domain", "c27_normalize_url", "c32_path_key",
    "f1_filter_source_catalog", "f2_filter_main_catalog", "f9_decode_filter_keys", "w1_relevance_search", "a2_duplicate_groups",
    "a7_facet_meta", "a11_uncategorized_hints", "a13_stock_by_barcode", "j1_match_stock_to_catalog", "j2_exists_in_main",
    "j6_diff_run_vs_previous", "h1_category_closure", "h6_validate_moves", "u1_upsert_source", "u6_replace_fields", "u12_fold_cart_events",
    "w2_best_record_dedup", "w11_user_history_page", "s4_read_catalog_csv", "s7_read_records_quarantine", "m2_build_source_product",
    "p5_opengraph_fields", "p11_page_links", "x1_stream_upsert", "x3_stream_cart_state", "x5_stream_view_counts",
]
CHOSEN = sorted(ORACLE) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, duck, name):
    problems, _ = compare(spark, duck, FOLDER, QUERIES[name], ORACLE[name])
    assert not problems


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
