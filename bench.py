"""Runs the headline queries and prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from townhall.plans import load_all
from townhall.plans.registry import QUERIES
from townhall.session import local_session

HEADLINE = [
    "score_articles", "dedupe_cascade", "event_dedupe", "upsert_events", "claim_filter", "project_keywords", "project_issue_areas", "project_entities",
    "explode_claims", "civic_actions", "timeline_items", "rerank", "select_evidence", "latest_run", "due_scrapers", "calendar_day", "rss_articles",
    "ics_events", "evidence_pack", "page_body_text", "dedupe_within_batch", "text_candidates", "search_documents", "stream_upsert_events",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = local_session("bench", cores, int(cores))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.time()
        # The whole result is computed; nothing is collected.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
