"""Slugs of imports: the first free number of a base, never one another owner has."""

from townhall.sources import imports

ORGS = "id long, city_id long, name string, slug string, type string"
SOURCES = "city_id long, slug string, name string, type string, source_url string, is_enabled boolean, schedule_cron string, legacy_id string"
ROWS = "id string, name string, scrape_type string, scrape_url string, is_active string, frequency string, pos long"


def test_organisations_take_free_slugs(spark):
    old = spark.createDataFrame([(1, 7, "Café", "cafe", "x"), (2, 7, "Café", "cafe-3", "x"), (3, 7, "R", "route-66", "x"), (4, 8, "Far", "route", "x")], ORGS)
    rows = spark.createDataFrame([("10", "Cafe", "gov", 1), ("11", "Cafe", "gov", 2), ("12", "Route", "gov", 3), ("13", "Cafe 2", "gov", 4), ("14", "Cafe", "", 5)], "id string, name string, type string, pos long")
    out = {r["id"]: r["slug"] for r in imports.import_organizations(rows, old, 7).collect()}
    # cafe-2 is wanted by "Cafe 2" itself, so "Cafe" goes on to the next free numbers.
    assert out == {1: "cafe", 2: "cafe-3", 3: "route-66", 4: "route", 10: "cafe-4", 11: "cafe-5", 12: "route", 13: "cafe-2", 14: "cafe-6"}


def test_numbers_of_plain_names(spark):
    old = spark.createDataFrame([(1, 7, "Café", "cafe", "x"), (2, 7, "Café", "cafe-3", "x"), (3, 7, "R", "route-66", "x")], ORGS)
    rows = spark.createDataFrame([("10", "Cafe", "gov", 1), ("11", "Cafe", "gov", 2), ("12", "Route", "gov", 3)], "id string, name string, type string, pos long")
    out = {r["id"]: r["slug"] for r in imports.import_organizations(rows, old, 7).collect()}
    assert [out[k] for k in (10, 11, 12)] == ["cafe-2", "cafe-4", "route"]


def test_sources_never_write_over_another_owner(spark):
    old = spark.createDataFrame([(7, "feed", "a", "rss", "u", True, None, "1"), (7, "feed-2", "b", "rss", "u", True, None, "2")], SOURCES)
    rows = spark.createDataFrame([("9", "Feed", "rss_feed", "u9", "1", "daily", 1), ("2", "Feed", "rss_feed", "u2", "1", "daily", 2), ("9", "Feed", "rss_feed", "u9b", "1", "daily", 3), ("8", "Feed", "rss_feed", "u8", "0", "daily", 4)], ROWS)
    out = {r["slug"]: (r["legacy_id"], r["source_url"]) for r in imports.import_scrapers(rows, old, 7).collect()}
    assert out == {"feed": ("1", "u"), "feed-2": ("2", "u2"), "feed-3": ("9", "u9b"), "feed-4": ("8", "u8")}
