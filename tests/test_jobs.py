"""Enrichment over several passes and run lifecycles over several micro-batches."""

import datetime as dt
import json

from pyspark.sql import functions as F

from townhall.operators import enrich
from townhall.operators.evidence import match_offsets, running
from townhall.session import settle
from townhall.streaming import jobs


def payload(people=(), slugs=(), opportunities=()):
    item = lambda **v: {**v, "confidence": 0.9, "evidence": [{"quote": "said"}]}
    return json.dumps({
        "analysis": {"dimensions": {}, "opportunities": list(opportunities), "confidence": 0},
        "enrichment": {"people": [item(name=p, role=None) for p in people], "issue_areas": [item(slug=s) for s in slugs]}, "confidence": 0.4})


def run(spark, outputs, stored=None, bodies=None):
    frame = spark.createDataFrame(outputs, "article_id long, city_id long, scraper_id long, payload string")
    none = lambda schema: spark.createDataFrame([], schema)
    cities = spark.createDataFrame([(1, "UTC"), (2, "UTC")], "city_id long, timezone string")
    areas = spark.createDataFrame([(5, 1, "Parks"), (6, 1, "roads")], "id long, city_id long, slug string")
    return enrich.enrich(
        frame, cities, none("id long, organization_id long"), none("id long, type string, name string"), areas, none("id long, city_id long, slug string, name string"),
        F.lit("2026-03-15 10:00:00").cast("timestamp_ntz"), settle, bodies, stored)


def test_unlisted_areas_go_only_where_the_city_has_a_list(spark):
    out = run(spark, [(1, 1, 1, payload(slugs=["parks", "space"])), (2, 2, 1, payload(slugs=["space"]))])
    found = {(r["article_id"], r["value_text"]) for r in out.claims.collect()}
    assert found == {(1, "parks"), (2, "space")}


def test_short_texts_are_gated_and_confidence_falls_back(spark):
    bodies = spark.createDataFrame([(1, "x" * 900), (2, " y " * 10)], "article_id long, cleaned_text string")
    out = run(spark, [(1, 1, 1, payload(people=["Ann"])), (2, 1, 1, payload(people=["Bob"])), (3, 1, 1, payload(people=["Cy"]))], bodies=bodies)
    assert [r["article_id"] for r in out.claims.collect()] == [1]
    assert {r["article_id"]: r["confidence"] for r in out.analyses.collect()} == {1: 0.4, 2: 0.0, 3: 0.0}


def test_a_later_pass_keeps_approved_and_foreign_claims(spark):
    first = run(spark, [(1, 1, 1, payload(people=["Ann", "Old"])), (9, 1, 1, payload(people=["Other"]))])
    name = F.col("value_text")
    stored = first.claims.withColumn("status", F.when(name == "Ann", "approved").otherwise(F.col("status")))
    foreign = stored.filter(name == "Old").withColumns({"source": F.lit("editor"), "value_text": F.lit("Edited")})
    second = run(spark, [(1, 1, 1, payload(people=["New"]))], settle(stored.unionByName(foreign)))
    assert {(r["value_text"], r["source"]) for r in second.claims.collect()} == {("Ann", "llm"), ("Edited", "editor"), ("New", "llm")}
    assert {r["display_name"] for r in second.entities.collect()} == {"Ann", "New"}


def test_opportunity_claims_stand_in(spark):
    base = run(spark, [(k, 1, 1, payload(people=["A"])) for k in (1, 2, 3)]).claims
    said = {1: {"opportunities": [{"type": "Meeting", "description": "one"}, {"type": "vote", "description": "two", "evidence": [{"quote": "own"}]}]}, 2: {"type": "meeting", "description": "single"}, 3: {}}
    text = F.col("article_id")
    value = F.when(text == 1, json.dumps(said[1])).when(text == 2, json.dumps(said[2])).otherwise(json.dumps(said[3]))
    stored = settle(base.withColumns({"claim_type": F.lit("article_opportunity"), "status": F.lit("approved"), "value_json": value}))
    own = [{"type": "meeting", "description": "payload"}]
    out = run(spark, [(1, 1, 1, payload()), (2, 1, 1, payload(opportunities=own)), (3, 1, 1, payload())], stored)
    assert sorted((r["article_id"], r["short_description"]) for r in out.civic_actions.collect()) == [(1, "one"), (1, "two"), (2, "payload")]


def test_ended_runs_stay_ended_over_many_batches(spark, tmp_path):
    day = dt.datetime(2026, 1, 1, 10)
    at = lambda m: day + dt.timedelta(minutes=m)
    batches = [
        [(1, 1, at(0), "running"), (2, 1, at(0), "running")], [(1, 1, at(5), "success")], [(1, 1, at(6), "running")], [(1, 1, at(8), "failed"), (3, 1, at(9), "running")],
        [(9, 9, at(200), "running")], [(9, 9, at(400), "running")], [(9, 9, at(600), "success")],
    ]
    schema = "source_id long, run_id long, ts timestamp, status string"
    source, out = tmp_path / "beats", []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"part={k}"))
    beats = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(source)).select("source_id", "run_id", "ts", "status")

    def each(batch, epoch):
        out.extend((r["source_id"], r["run_id"], r["status"]) for r in batch.collect())

    jobs.run_available(jobs.run_lifecycle(beats), str(tmp_path / "checkpoint"), each)
    assert sorted(x for x in out if x[0] != 9) == [(1, 1, "success"), (2, 1, "stuck"), (3, 1, "stuck")]


def test_running_sums_over_many_blocks(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        got = spark.createDataFrame([([k % 7 for k in range(n)],)], "x array<int>").select(running(F.col("x"))).first()[0]
        want, at = [], 0
        for k in range(n):
            want.append(at)
            at += k % 7
        assert got == want


def test_offsets_cost_in_proportion_to_the_matches(spark):
    import time

    took = []
    for n in (4_000, 16_000):
        df = settle(spark.createDataFrame([("ab 12:30 " * n,)], "t string"))
        df.select(F.size(match_offsets(F.col("t"), r"\d+:\d+"))).first()
        start = time.time()
        assert df.select(F.size(match_offsets(F.col("t"), r"\d+:\d+"))).first()[0] == n
        took.append(time.time() - start)
    assert took[1] < 8 * took[0] + 1
