"""The catalogue runs on the smallest data and agrees with its SQL twins there."""

import pytest

import __spark_entry__ as entry
from check_oracle import check, connect

FOLDER = "/root/testdata/sf0.001"
FAST = ("timeline_page", "timeline_filtered", "shadowed_other", "evidence_summary", "cross_search", "person_list", "source_list",
        "digest_items", "digest_texts", "digest_rule_rejects", "run_status_rollup", "orphan_events", "retime_report", "page_documents",
        "feed_documents", "segments", "attribution", "document_duplicates", "stream_daily_counts",
        "clean_family", "clean_article_arms", "evidence_locations", "attribution_reasons", "repair_audit", "discover_candidates")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_agrees_with_sql(spark, name):
    ok, note = check(spark, connect(FOLDER), name, FOLDER)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() == 20
