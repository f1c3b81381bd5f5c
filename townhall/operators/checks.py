"""Validity rules as a report of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall.functions.text import trim_all
from townhall.operators.skew import lookup_join
from townhall.session import settle

URL_SHAPE = r"^https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#]\S*)?$"


def violations(rows: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """(id, rule) for every rule whose condition is true."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return rows.select(key, F.explode(found).alias("rule"))


def required(name: str) -> Column:
    text = F.col(name).cast("string")
    return text.isNull() | (F.length(trim_all(text)) == 0)


def too_long(name: str, n: int) -> Column:
    return F.length(name) > n


def bad_url(name: str) -> Column:
    """Not a URL; placeholders in braces are read as 1."""
    url = F.regexp_replace(trim_all(F.col(name)), r"\{[^}]+\}", "1")
    return ~url.rlike(URL_SHAPE)


def not_in(name: str, values: list[str]) -> Column:
    return ~F.col(name).isin(values)


def duplicate_keys(rows: DataFrame, columns: list[str], rule: str, key: str = "id") -> DataFrame:
    """(id, rule) of rows that share a key that must be unique.

    Keys are counted with map-side combine and only repeated ones are looked up.
    """
    repeated = rows.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # Written first: a hot key of two plain inputs can be split at run time.
    return lookup_join(rows.select(key, *columns), settle(repeated), columns, spread=key).select(key, F.lit(rule).alias("rule"))


def missing_reference(rows: DataFrame, column: str, target: DataFrame, rule: str, key: str = "id") -> DataFrame:
    """(id, rule) of rows whose reference points nowhere."""
    known = target.select(F.col("id").alias(column)).distinct()
    return rows.filter(F.col(column).isNotNull()).join(known, column, "left_anti").select(key, F.lit(rule).alias("rule"))


def scraper_checks(scrapers: DataFrame, cities: DataFrame, organizations: DataFrame) -> DataFrame:
    rules = {
        "city_required": required("city_id"), "name_required": required("name"), "name_length": too_long("name", 255),
        "slug_required": required("slug"), "slug_length": too_long("slug", 255), "type_allowed": not_in("type", ["rss", "html", "api"]),
        "source_url_required": required("source_url"), "source_url_shape": bad_url("source_url"), "source_url_length": too_long("source_url", 2000),
        "frequency_allowed": not_in("frequency", ["hourly", "daily", "weekly"]),
        "run_at_format": ~F.col("run_at").rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"),
        "run_day_range": ~F.col("run_day_of_week").between(0, 6),
        "run_day_required": (F.col("frequency") == "weekly") & F.col("run_day_of_week").isNull(),
    }
    return (
        violations(scrapers, rules)
        .unionByName(duplicate_keys(scrapers, ["city_id", "slug"], "slug_unique"))
        .unionByName(missing_reference(scrapers, "city_id", cities, "city_exists"))
        .unionByName(missing_reference(scrapers, "organization_id", organizations, "organization_exists"))
    )


def organization_checks(organizations: DataFrame, cities: DataFrame, types: list[str]) -> DataFrame:
    rules = {
        "city_required": required("city_id"), "name_required": required("name"), "name_length": too_long("name", 255),
        "slug_required": required("slug"), "type_allowed": not_in("type", types), "website_shape": bad_url("website"),
        "website_length": too_long("website", 255),
    }
    return (
        violations(organizations, rules).unionByName(duplicate_keys(organizations, ["city_id", "slug"], "slug_unique"))
        .unionByName(missing_reference(organizations, "city_id", cities, "city_exists"))
    )


def event_checks(events: DataFrame, cities: DataFrame) -> DataFrame:
    rules = {
        "city_required": required("city_id"), "title_required": required("title"), "title_length": too_long("title", 255),
        "starts_at_required": F.col("starts_at").isNull(), "event_url_shape": bad_url("event_url") & (F.col("event_url") != ""),
        "event_url_length": too_long("event_url", 2000),
    }
    return violations(events, rules).unionByName(missing_reference(events, "city_id", cities, "city_exists"))


def event_source_checks(sources: DataFrame, cities: DataFrame, types: list[str]) -> DataFrame:
    rules = {
        "city_required": required("city_id"), "name_required": required("name"), "name_length": too_long("name", 255),
        "source_type_allowed": not_in("source_type", types), "source_url_required": required("source_url"),
        "source_url_shape": bad_url("source_url"), "source_url_length": too_long("source_url", 2000),
    }
    return violations(sources, rules).unionByName(missing_reference(sources, "city_id", cities, "city_exists"))


def city_checks(cities: DataFrame) -> DataFrame:
    rules = {"name_required": required("name"), "name_length": too_long("name", 255), "slug_required": required("slug"), "slug_length": too_long("slug", 255)}
    return violations(cities, rules).unionByName(duplicate_keys(cities, ["slug"], "slug_unique"))
