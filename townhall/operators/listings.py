"""Dashboard figures, listings and run lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townhall.config import SCRAPER_TYPES
from townhall.operators.ranking import rank_in_buckets
from townhall.session import settle


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered listing; only number * size rows leave each task."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


@dataclass
class Pages:
    """An ordered listing that was cut into ranges: rows with their range, and per range the number of rows before it."""

    rows: DataFrame
    starts: list[int]  # of every range, and the number of all rows; bounded by the number of partitions
    order: list[Column]
    size: int

    def page(self, number: int) -> DataFrame:
        """Rows of page ``number`` (from 1) with ``position``; only the ranges that hold them are read, whatever the page."""
        lo, hi = (number - 1) * self.size, number * self.size
        here = [k for k in range(len(self.starts) - 1) if self.starts[k] < hi and self.starts[k + 1] > lo]
        part = self.rows.filter(F.col("_range").isin(here) if here else F.lit(False))
        start = F.element_at(F.array(*[F.lit(n) for n in self.starts]), F.col("_range") + 1)
        place = F.row_number().over(W.partitionBy("_range").orderBy(*self.order)) + start
        return part.withColumn("position", place).filter((F.col("position") > lo) & (F.col("position") <= hi)).drop("_range")

    def bounds(self) -> DataFrame:
        """page, first_position and the first row of every page, so that a client can seek to it by its key."""
        start = F.element_at(F.array(*[F.lit(n) for n in self.starts]), F.col("_range") + 1)
        place = F.row_number().over(W.partitionBy("_range").orderBy(*self.order)) + start
        firsts = self.rows.withColumn("first_position", place).filter((F.col("first_position") - 1) % self.size == 0)
        return firsts.withColumn("page", F.floor((F.col("first_position") - 1) / self.size) + 1).drop("_range")


def paged(rows: DataFrame, order: list[Column], size: int) -> Pages:
    """Rows dealt by range over the order and written, one folder per range, so that a late page costs what the first one does.

    ``order`` must be total for stable pages. Rows with equal keys lie in one range; the driver gets one number per range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    held = settle(dealt, ["_range"])
    counts = dict(held.groupBy("_range").count().collect())
    starts = [0]
    for k in range(n):
        starts.append(starts[-1] + counts.get(k, 0))
    return Pages(held, starts, order, size)


def dashboard_rollup(runs: DataFrame, scrapers: DataFrame) -> DataFrame:
    """Runs and written items per city, source and status, per city and source, per city, and in all: one grouping.

    ``level`` is the grouping id: 0 for the finest groups, 1, 3 and 7 where status, source and city are summed over. Runs of unknown sources have no city.
    """
    city = scrapers.select(F.col("id").alias("scraper_id"), "city_id")
    rows = runs.select("scraper_id", "status", "items_written").join(city, "scraper_id", "left")
    return rows.rollup("city_id", "scraper_id", "status").agg(
        F.grouping_id().alias("level"), F.count("*").alias("runs"), F.sum("items_written").alias("items_written"))


def dashboard_counts(cities: DataFrame, organizations: DataFrame, scrapers: DataFrame) -> DataFrame:
    tag = lambda df, t, on: df.select(F.lit(t).alias("t"), on.alias("on"))
    rows = tag(cities, "c", F.lit(True)).unionByName(tag(organizations, "o", F.lit(True))).unionByName(tag(scrapers, "s", F.col("is_enabled")))
    n = lambda cond: F.count_if(cond)
    t = F.col("t")
    return rows.agg(n(t == "c").alias("cities"), n(t == "o").alias("organizations"), n(t == "s").alias("scrapers"),
                    n((t == "s") & F.col("on")).alias("active_scrapers"))


def _since(as_of: Column, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(-days), as_of)


def articles_recent(articles: DataFrame, as_of: Column) -> DataFrame:
    at = F.col("created_at")
    return articles.agg(F.count_if(at >= _since(as_of, 1)).alias("last_24h"), F.count_if(at >= _since(as_of, 7)).alias("last_7d"))


def events_written_recent(runs: DataFrame, as_of: Column) -> DataFrame:
    at, n = F.col("finished_at"), F.col("items_written")
    total = lambda days: F.coalesce(F.sum(F.when(at >= _since(as_of, days), n)), F.lit(0))
    return runs.filter(at >= _since(as_of, 7)).agg(total(1).alias("last_24h"), total(7).alias("last_7d"))


def recent_runs(runs: DataFrame, scrapers: DataFrame, cities: DataFrame, organizations: DataFrame, n: int) -> DataFrame:
    """The latest finished runs with names; names join after the top n are known."""
    top = runs.orderBy(F.col("finished_at").desc_nulls_first(), F.col("started_at").desc_nulls_first(), "id").limit(n)
    s = scrapers.select(F.col("id").alias("scraper_id"), F.col("name").alias("scraper_name"), "city_id", "organization_id")
    c = cities.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"))
    o = organizations.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"))
    return top.join(s, "scraper_id", "left").join(c, "city_id", "left").join(o, "organization_id", "left")


def events_listing(events: DataFrame, source_items: DataFrame, start: str, end: str, city_id: int | None = None,
                   source_id: int | None = None, with_url: bool = False) -> DataFrame:
    """Events of an inclusive date range (swapped when reversed) with the optional filters."""
    lo, hi = min(start, end), max(start, end)
    rows = events.filter((F.col("starts_at") >= F.lit(f"{lo} 00:00:00").cast("timestamp_ntz"))
                         & (F.col("starts_at") < F.date_add(F.lit(hi).cast("date"), 1).cast("timestamp_ntz")))
    if city_id is not None:
        rows = rows.filter(F.col("city_id") == city_id)
    if with_url:
        rows = rows.filter(F.col("event_url").isNotNull() & (F.col("event_url") != ""))
    if source_id is not None:
        ids = source_items.filter(F.col("event_source_id") == source_id).select(F.col("event_id").alias("id"))
        rows = rows.join(ids, "id", "left_semi")
    return rows


def _matches(search: str, *columns: str) -> Column:
    """Any of the columns holds the text."""
    out = F.lit(False)
    for name in columns:
        out = out | F.coalesce(F.col(name).contains(search), F.lit(False))
    return out


def event_sources_search(sources: DataFrame, cities: DataFrame, search: str = "", city_id: int | None = None,
                         source_type: str | None = None, active_only: bool = False) -> DataFrame:
    rows = sources.join(cities.select(F.col("id").alias("city_id"), F.col("name").alias("city_name")), "city_id", "left")
    if search.strip():
        rows = rows.filter(_matches(search.strip(), "name", "source_url", "source_type", "city_name"))
    if city_id is not None:
        rows = rows.filter(F.col("city_id") == city_id)
    if source_type:
        rows = rows.filter(F.col("source_type") == source_type)
    return rows.filter("is_active") if active_only else rows


SCRAPER_SORT = {
    "scrapers.id": "id", "organization_name": "organization_name", "scrapers.type": "type", "scrapers.source_url": "source_url",
    "scrapers.is_enabled": "is_enabled", "scrapers.updated_at": "updated_at",
}


def scrapers_listing(scrapers: DataFrame, organizations: DataFrame, search: str = "", organization_id: int | None = None,
                     city_id: int | None = None, type_: str | None = None, active_only: bool = False) -> DataFrame:
    names = organizations.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"))
    rows = scrapers.join(names, "organization_id", "left")
    if city_id is not None:
        rows = rows.filter(F.col("city_id") == city_id)
    if organization_id is not None:
        rows = rows.filter(F.col("organization_id") == organization_id)
    if type_:
        rows = rows.filter(F.col("type") == type_)
    if active_only:
        rows = rows.filter("is_enabled")
    if search.strip():
        rows = rows.filter(_matches(search.strip(), "name", "slug", "source_url", "organization_name"))
    return rows


def scraper_order(field: str | None, direction: str = "asc") -> list[Column]:
    """Whitelisted sort; unknown fields fall back to the update time, none means newest first."""
    if not field:
        return [F.col("updated_at").desc(), F.col("id")]
    c = F.col(SCRAPER_SORT.get(field, "updated_at"))
    return [c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last(), F.col("id")]


def source_run_history(runs: DataFrame, n: int, key: str = "scraper_id") -> DataFrame:
    """The last n runs per source, newest first; at most n rows per source and task are shuffled."""
    w = W.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return runs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def latest_run(runs: DataFrame, key: str = "scraper_id") -> DataFrame:
    """Latest run and latest finished successful run per source, one grouping."""
    ok = (F.col("status") == "success") & F.col("finished_at").isNotNull()
    success_order = F.when(ok, F.struct("finished_at", "id"))
    return runs.groupBy(key).agg(
        F.max_by(F.struct("id", "status"), F.struct("created_at", "id")).alias("latest"),
        F.max(success_order).alias("success"),
    ).select(key, F.col("latest.id").alias("latest_run_id"), F.col("latest.status").alias("latest_status"),
             F.col("success.id").alias("success_run_id"), F.col("success.finished_at").alias("success_at"))


def calendar_days(events: DataFrame) -> DataFrame:
    """Every event in its city-day: all-day ones apart, timed ones labelled HH:mm, in order.

    Rows stay rows: a city-day is read by filtering on city_id and day.
    """
    c = F.col
    rows = events.filter("starts_at IS NOT NULL").withColumns({
        "day": c("starts_at").cast("date"), "section": F.when(c("all_day"), "all_day").otherwise("timed"),
        "time_label": F.when(~c("all_day"), F.date_format("starts_at", "HH:mm"))})
    return rank_in_buckets(rows, ["city_id", "day", "section"], F.hour("starts_at") * 60 + F.minute("starts_at"), [c("starts_at"), c("id")], "position")


def calendar_day(events: DataFrame, city_id: int, day: str) -> DataFrame:
    """One city-day; the filters reach the scan."""
    at = F.col("starts_at")
    start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    return calendar_days(events.filter((F.col("city_id") == city_id) & (at >= start) & (at < F.timestamp_add("DAY", F.lit(1), start))))


def event_trace(events: DataFrame, items: DataFrame) -> DataFrame:
    """Each event with its first source item and that item's raw payload."""
    first = items.groupBy("event_id").agg(F.min("id").alias("item_id"), F.min_by(F.struct("event_source_id", "raw_payload"), "id").alias("i"))
    first = first.select(F.col("event_id").alias("id"), "item_id", "i.*")
    return events.join(first, "id", "left")


def runnable_sources(sources: DataFrame, types: list[str] = SCRAPER_TYPES, type_column: str = "type", active_column: str = "is_enabled",
                     source_id: int | None = None, city_id: int | None = None) -> DataFrame:
    rows = sources.filter(F.col(active_column) & F.col(type_column).isin(types))
    if source_id is not None:
        rows = rows.filter(F.col("id") == source_id)
    return rows if city_id is None else rows.filter(F.col("city_id") == city_id)
