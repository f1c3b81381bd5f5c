"""Queries against their oracle on the smallest data.

By default one query per family runs; TOWNHALL_ORACLE=all runs every one of them.
"""

import os

import oracle
import pytest

from townhall.plans import load_all
from townhall.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
load_all()
QUICK = [
    "source_hash", "slugify", "parse_event_date", "score_articles", "dedupe_cascade", "dedupe_within_batch", "upsert_articles", "replace_claims",
    "explode_claims", "keyword_dictionary", "project_entities", "civic_actions", "timeline_items", "rerank", "latest_run", "due_scrapers",
    "record_checks", "rss_articles", "ics_events", "json_events_generic", "text_signals", "stream_run_stats",
    "relevance_candidates", "answer_contexts", "dashboard_rollup", "page_bounds", "stream_sessions", "replace_projection",
]
KEYS = sorted(ORACLES) if os.environ.get("TOWNHALL_ORACLE") == "all" else QUICK


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    assert oracle.compare(spark, duck, key, QUERIES, ORACLES, SMALL) is None


def test_every_query_has_an_oracle():
    assert sorted(set(QUERIES) - set(ORACLES)) == []


def test_inventory_size():
    assert len(QUERIES) == 163


def test_an_enrichment_pass_meets_the_stored_keywords(spark, duck):
    assert oracle.compare(spark, duck, "enrich_pipeline", QUERIES, ORACLES, SMALL) is None
    counts = QUERIES["enrich_pipeline"](spark, SMALL)
    n = counts.selectExpr("count(*) AS articles", "sum(n_keywords) AS keywords", "sum(n_known_keywords) AS known", "sum(n_analyses) AS analyses").first()
    assert 0 < n.known < n.keywords and n.analyses == n.articles
