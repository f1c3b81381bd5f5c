"""Known inputs and their results."""

import datetime as dt

from pyspark.sql import functions as F

from townhall.functions import dates, text, urls
from townhall.operators import schedule
from townhall.sources import calendars


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_time_range(spark):
    r = one(spark, dates.parse_event_date(F.lit("January 15, 2026"), F.lit("7:00 PM - 8:30 PM"), F.lit("America/Chicago"), F.lit(2026)).alias("r"))["r"]
    assert (r["starts_at"], r["ends_at"], r["all_day"]) == (dt.datetime(2026, 1, 15, 19), dt.datetime(2026, 1, 15, 20, 30), False)


def test_date_shapes(spark):
    shapes = {"Jan. 5, 2026": (2026, 1, 5), "1/5/26": (2026, 1, 5), "5-1-2026": (2026, 1, 5), "Tuesday, March 3": (2025, 3, 3),
              "Tue, 06 Jan 2026 10:00:00 -0600": (2026, 1, 6), "2026-01-05T10:00": (2026, 1, 5), "soon": None, "2/30/2026": None}
    got = one(spark, *[dates.parse_date_part(F.lit(s), F.lit(2025)).alias(f"c{i}") for i, s in enumerate(shapes)])
    assert [None if d is None else (d.year, d.month, d.day) for d in got] == list(shapes.values())


def test_absolute_urls(spark):
    base = F.lit("https://a.example.org:8080/list/index?x=1")
    cases = {"/e": "https://a.example.org:8080/e", "e": "https://a.example.org:8080/list/e", "//b/c": "https://b/c", "http://z/": "http://z/", " ": None}
    got = one(spark, *[urls.absolute_url(F.lit(u), base).alias(f"c{i}") for i, u in enumerate(cases)])
    assert list(got) == list(cases.values())


def test_slug_and_limit(spark):
    r = one(spark, text.slugify(F.lit(" Straße & Café_No. 5 ")).alias("a"), text.limit_text(F.lit("abc def"), 4).alias("b"), text.first_sentence(F.lit("One? Two. Three")).alias("c"))
    assert tuple(r) == ("strasse-cafe-no-5", "abc...", "One?")


def test_simpleview_utc_date_is_local_evening(spark):
    body = '{"docs":{"docs":[{"recid":"9","title":"T","date":"2026-01-13T05:59:59.000Z","startTime":"19:30:00","url":"/e/9"}]}}'
    p = spark.createDataFrame([(1, 1, 1, "https://x.example.org/a", body, "America/Chicago")], "payload_id int, source_id int, city_id int, request_url string, body string, zone string")
    r = calendars.json_simpleview(p, "https://x.example.org").first()
    assert r["starts_at"] == dt.datetime(2026, 1, 12, 19, 30) and r["given_hash"] == "visitwichita:9:2026-01-13T05:59:59.000Z:19:30:00"


def test_daily_source_is_due_in_one_zone_only(spark):
    cities = spark.createDataFrame([(1, "America/Chicago"), (2, "America/Los_Angeles")], "id bigint, timezone string")
    scrapers = spark.createDataFrame([(1, 1, True, "rss", "daily", "09:00", None), (2, 2, True, "rss", "daily", "09:00", None)],
                                     "id bigint, city_id bigint, is_enabled boolean, type string, frequency string, run_at string, run_day_of_week int")
    runs = spark.createDataFrame([], "id bigint, scraper_id bigint, status string, created_at timestamp_ntz, finished_at timestamp_ntz")
    due = schedule.due_scrapers(scrapers, cities, runs, F.lit("2025-01-02 16:00:00").cast("timestamp_ntz"))
    assert [r["id"] for r in due.collect()] == [1]


def test_stream_in_several_batches_equals_one_batch(spark, tmp_path):
    from townhall.streaming import jobs

    rows = [(i % 3, f"2026-01-0{i % 5 + 1} 10:00:00", i) for i in range(30)]
    df = spark.createDataFrame(rows, "scraper_id bigint, t string, items_written bigint").withColumn("finished_at", F.col("t").cast("timestamp"))
    for i in range(3):
        df.filter(f"items_written % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = jobs.Snapshots(str(tmp_path / "out"))
    last = jobs.run_available(jobs.run_stats(stream, "1 day", "1 day", "30 days"), str(tmp_path / "ck"), jobs.keep_stats(store), "update")
    got = {(r["scraper_id"], r["window_start"].day): r["items_written"] for r in spark.read.parquet(store.path("stats", last)).collect()}
    want = {}
    for s, t, n in rows:
        want[(s, int(t[8:10]))] = want.get((s, int(t[8:10])), 0) + n
    assert got == want and last >= 2
