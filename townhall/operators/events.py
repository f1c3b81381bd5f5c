"""Calendar events: normalisation, identity and keyed snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall.functions.dates import to_utc
from townhall.functions.scalars import source_hash
from townhall.functions.text import clean_location, trim_all
from townhall.functions.urls import absolute_url


def writable(title: Column, starts_at: Column) -> Column:
    """An item is written only with a title and a start."""
    return F.coalesce(F.length(trim_all(title)) > 0, F.lit(False)) & starts_at.isNotNull()


def normalize_events(items: DataFrame, cities: DataFrame) -> DataFrame:
    """Writable items with clean places, absolute URLs and the identity hash.

    ``cities`` (city_id, timezone) has one row per city and is small by nature;
    the optimiser broadcasts it from its size.
    """
    zone = F.coalesce("timezone", F.lit("UTC"))
    given = F.col("given_hash") if "given_hash" in items.columns else F.lit(None).cast("string")
    event_url = absolute_url(F.col("event_url"), F.col("feed_url"))
    return (
        items.filter(writable(F.col("title"), F.col("starts_at_local")))
        .join(cities, "city_id", "left")
        .withColumns({
            "title": trim_all(F.col("title")),
            "source_hash": source_hash(
                given, F.col("city_id"), F.col("title"), to_utc(F.col("starts_at_local"), zone),
                F.col("location_name"), F.col("location_address")),
            "location_name": clean_location(F.col("location_name")),
            "location_address": clean_location(F.col("location_address")),
            "event_url": event_url,
            "source_url": F.coalesce(event_url, absolute_url(F.col("feed_url"), F.col("feed_url"))),
        })
    )


def packed(df: DataFrame) -> DataFrame:
    """The identity hash as its 20 bytes; as text it is 40 characters that no shuffle can compress."""
    return df.withColumn("source_hash", F.unhex("source_hash"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.withColumn("source_hash", F.lower(F.hex("source_hash")))
