"""Which sources are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall.config import DEFAULT_RUN_AT, SCRAPER_TYPES
from townhall.functions.dates import to_local
from townhall.operators.listings import latest_run, runnable_sources
from townhall.operators.runs import sources_without_active_run


def run_at_minutes(run_at: Column) -> Column:
    """Minutes after midnight of HH:mm text; anything unusable means the default."""

    def read(c: Column) -> Column:
        h = F.regexp_extract(c, r"^\s*(\d+):(\d+)", 1).try_cast("int")
        m = F.regexp_extract(c, r"^\s*(\d+):(\d+)", 2).try_cast("int")
        return F.when(h.between(0, 23) & m.between(0, 59), h * 60 + m)

    return F.coalesce(read(run_at), read(F.lit(DEFAULT_RUN_AT)))


def week_start(day: Column) -> Column:
    """Sunday on or before the day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def due_scrapers(scrapers: DataFrame, cities: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Enabled sources without an active run whose hourly, daily or weekly time has come.

    ``as_of`` is UTC wall-clock. Runs are reduced to one row per source before the join.
    """
    c = F.col
    ready = sources_without_active_run(runnable_sources(scrapers, SCRAPER_TYPES), runs)
    last = latest_run(runs).select(c("scraper_id").alias("id"), "success_at")
    zone = F.coalesce("timezone", F.lit("UTC"))
    rows = ready.join(cities.select(c("id").alias("city_id"), "timezone"), "city_id", "left").join(last, "id", "left").withColumns({
        "now_local": to_local(as_of, zone), "last_local": to_local(c("success_at"), zone), "minutes": run_at_minutes(c("run_at"))})
    past_run_at = F.hour("now_local") * 60 + F.minute("now_local") >= c("minutes")
    today, last_day = c("now_local").cast("date"), c("last_local").cast("date")
    never = c("success_at").isNull()
    hourly = never | (as_of >= F.timestamp_add("MINUTE", F.lit(60), c("success_at")))
    daily = past_run_at & (never | (last_day != today))
    weekly = (
        (F.dayofweek(today) - 1 == c("run_day_of_week")) & past_run_at
        & (never | (week_start(last_day) < week_start(today)))
    )
    frequency = F.coalesce("frequency", F.lit("daily"))
    due = F.when(frequency == "hourly", hourly).when(frequency == "daily", daily).when(frequency == "weekly", weekly).otherwise(False)
    return rows.filter(F.coalesce(due, F.lit(False))).drop("now_local", "last_local", "minutes")
