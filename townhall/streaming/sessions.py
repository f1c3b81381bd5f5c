"""Sessions of heartbeats: runs of beats without a long silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessions(beats: DataFrame, gap: Column | str, delay: str = "10 minutes") -> DataFrame:
    """source_id, started_at, ended_at, beats: a session goes on while the next beat of its source comes within the gap of an earlier one.

    ``gap`` is a duration, or a column with one for each beat. ``ended_at`` is the end of the gap after the beat that reaches furthest. Beats
    that come up to ``delay`` late are placed by their time; later ones are dropped. A closed session leaves the state with the watermark.
    ``beats``: source_id, ts (timestamp).
    """
    w = F.session_window("ts", gap)
    return beats.withWatermark("ts", delay).groupBy("source_id", w.alias("w")).agg(F.count("*").alias("beats")).select(
        "source_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "beats")
