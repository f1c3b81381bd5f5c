"""Structured Streaming jobs. They share the batch operators.

State lives in snapshot tables of a shared folder. Micro-batch N reads snapshot
N - 1 and writes snapshot N, so a batch that is run again after a failure gives
the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from townhall.operators import enrich as enrichment
from townhall.operators import heuristics, ingest, merge
from townhall.operators.events import normalize_events, packed, unpacked


class Snapshots:
    """Versioned tables under one root: <root>/<table>/v<epoch>."""

    def __init__(self, root: str):
        self.root = root

    def path(self, table: str, epoch: int) -> str:
        return f"{self.root}/{table}/v{epoch}"

    def read(self, spark: SparkSession, table: str, epoch: int, schema: str) -> DataFrame:
        """Snapshot of the epoch; before the first one the table is empty."""
        if epoch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path(table, epoch))

    def write(self, df: DataFrame, table: str, epoch: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table, epoch))

    def prune(self, spark: SparkSession, tables: tuple[str, ...], epoch: int) -> None:
        """Remove what no batch can read again: a repeated batch N reads N - 1, so N - 2 may go."""
        for table in tables:
            old = spark._jvm.org.apache.hadoop.fs.Path(self.path(table, epoch - 2))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], output_mode: str = "append") -> int:
    """Process everything that is there, batch by batch; returns the last epoch."""
    q = stream.writeStream.foreachBatch(each).outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return max((p["batchId"] for p in q.recentProgress), default=-1)


ARTICLES = "id bigint, city_id bigint, title string, summary string, content_type string, status string, canonical_url string, content_hash string"
BODIES = "article_id bigint, cleaned_text string, lang string"
SOURCES = "article_id bigint, city_id bigint, source_url string, source_uid string, source_type string"


def ingest_articles(store: Snapshots, to_items: Callable[[DataFrame], DataFrame] = lambda b: b):
    """foreachBatch handler: item stream to article, body and source snapshots."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = [store.read(spark, t, epoch - 1, s) for t, s in (("articles", ARTICLES), ("bodies", BODIES), ("sources", SOURCES))]

        def settle(df: DataFrame) -> DataFrame:
            store.write(df, "resolved", epoch)
            return spark.read.parquet(store.path("resolved", epoch))

        new = ingest.ingest(to_items(batch), *old, settle=settle)
        for table, df in zip(("articles", "bodies", "sources"), new):
            store.write(df, table, epoch)
        store.prune(spark, ("articles", "bodies", "sources", "resolved"), epoch)

    return each


EVENTS = "source_hash string, city_id bigint, title string, starts_at timestamp_ntz, all_day boolean, location_name string, event_url string"
EVENT_ITEMS = "source_hash string, event_source_id bigint, source_url string, external_id string, last_pos string"


def upsert_events(store: Snapshots, cities: DataFrame, to_items: Callable[[DataFrame], DataFrame] = lambda b: b):
    """foreachBatch handler: calendar items to event and source-item snapshots, last one wins."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        items = packed(normalize_events(to_items(batch), cities).withColumn("starts_at", F.col("starts_at_local")).withColumn("last_pos", F.col("pos")))
        events, trace = packed(store.read(spark, "events", epoch - 1, EVENTS)), packed(store.read(spark, "items", epoch - 1, EVENT_ITEMS))
        store.write(unpacked(merge.upsert(events, items, ["source_hash"], "pos", first=epoch == 0)), "events", epoch)
        store.write(unpacked(merge.upsert(trace, items, ["source_hash", "event_source_id", "source_url", "external_id"], "pos", first=epoch == 0)), "items", epoch)
        store.prune(spark, ("events", "items"), epoch)

    return each


def drop_resends(items: DataFrame, event_time: str, delay: str, keys: list[str]) -> DataFrame:
    """Drop exact re-sends that arrive within the watermark delay."""
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def score_and_enrich(store: Snapshots, to_outputs: Callable[[DataFrame], DataFrame], cities: DataFrame, scrapers: DataFrame, organizations: DataFrame,
                     areas: DataFrame, as_of: Column, to_articles: Callable[[DataFrame], DataFrame] | None = None,
                     to_bodies: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch handler: changed articles to scores, claims and the read tables.

    Rows of articles in the batch replace their older rows. Of the claims only proposed ones of the same source
    are replaced; approved, rejected and foreign ones stay. The micro-batch is parsed once, all eight tables of a pass are written.
    """
    keywords_schema = "id bigint, city_id bigint, slug string, name string"

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        keywords = store.read(spark, "keyword_names", epoch - 1, keywords_schema)

        def settle(df: DataFrame) -> DataFrame:
            store.write(df, "normalized", epoch)
            return spark.read.schema(df.schema).parquet(store.path("normalized", epoch))

        held = None if epoch == 0 else spark.read.parquet(store.path("claims", epoch - 1))
        bodies = None if to_bodies is None else to_bodies(batch)
        result = enrichment.enrich(to_outputs(batch), cities, scrapers, organizations, areas, keywords, as_of, settle, bodies, held)
        touched = spark.read.parquet(store.path("normalized", epoch)).select("article_id").distinct()
        names = ("claims", "analyses", "keywords", "entities", "issue_areas", "civic_actions", "timeline_items", "explainers")
        tables = {name: getattr(result, name) for name in names}
        if to_articles is not None:
            tables["scores"] = heuristics.score_articles(to_articles(batch), scrapers, organizations, as_of).select(
                "article_id", "status", "civic_relevance")
        for name, df in tables.items():
            # The claims of an article that stay are among those of the pass.
            old = df.limit(0) if epoch == 0 else spark.read.parquet(store.path(name, epoch - 1))
            store.write(merge.replace_groups(old, df, ["article_id"], touched), name, epoch)
        store.write(result.dictionary, "keyword_names", epoch)
        store.prune(spark, (*tables, "keyword_names", "normalized"), epoch)

    return each


def run_stats(runs: DataFrame, width: str = "7 days", slide: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Items written per source and window of the finish time; runs later than the watermark are dropped."""
    rows = runs.filter("finished_at IS NOT NULL").withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    return rows.withWatermark("finished_at", delay).groupBy("scraper_id", F.window("finished_at", width, slide).alias("w")).agg(
        F.sum("items_written").alias("items_written"), F.count("*").alias("runs"))


STATS = "scraper_id bigint, window_start timestamp, items_written bigint, runs bigint"


def keep_stats(store: Snapshots):
    """foreachBatch handler in update mode: the newest value of every window."""

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("scraper_id", F.col("w.start").alias("window_start"), "items_written", "runs", F.lit(epoch).alias("pos"))
        old = store.read(batch.sparkSession, "stats", epoch - 1, STATS)
        store.write(merge.upsert(old, rows, ["scraper_id", "window_start"], "pos"), "stats", epoch)
        store.prune(batch.sparkSession, ("stats",), epoch)

    return each


# --- run lifecycle: the one job with custom state -------------------------------------

LIFECYCLE = "source_id bigint, run_id bigint, status string, started_at timestamp, last_seen timestamp, beats bigint"
LIFECYCLE_STATE = "runs binary"
TERMINAL = ("success", "failed")
QUIET_MS = 60 * 60 * 1000
BUCKETS = 1024  # of runs; a bucket is one row of state
RUN = ["source_id", "run_id", "absent"]  # ids, 0 where they are null, and which of them are: 1 the first, 2 the second
OPEN_RUN = np.dtype([("source_id", "i8"), ("run_id", "i8"), ("absent", "i8"), ("first", "i8"), ("last", "i8"), ("beats", "i8"), ("closed", "?"), ("until", "i8")])
NEVER = np.iinfo("i8").max


def _per_run(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per run: its first and last time, its beats, and the earliest final status."""
    return rows.sort_values(["rank", "status"]).groupby(RUN, sort=False, as_index=False).agg(
        first=("first", "min"), last=("last", "max"), beats=("beats", "sum"), closed=("closed", "max"), until=("until", "max"), seen=("seen", "max"),
        rank=("rank", "first"), status=("status", "first"))


def _beat_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    at = pdf["ts"].astype("datetime64[us]").astype("int64")
    ended = pdf["status"].isin(TERMINAL)
    rank = at.where(at != np.iinfo("i8").min, NEVER - 1).where(ended, NEVER)
    return _per_run(pd.DataFrame({
        **{k: pdf[k].astype("int64") for k in RUN}, "first": at, "last": at, "beats": 1, "closed": False, "until": 0, "seen": True, "rank": rank, "status": pdf["status"].where(ended, "")}))


def _lifecycle(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The runs of one bucket: each remembers first and last heartbeat, ends on a final status or when it goes quiet.

    An ended run stays marked as closed until an hour after its last heartbeat, so that late ones do not open it again.
    """
    now = state.getCurrentWatermarkMs()
    rows = pd.DataFrame(np.frombuffer(state.get[0] if state.exists else b"", OPEN_RUN)).assign(seen=False, rank=NEVER, status="")
    for pdf in () if state.hasTimedOut else batches:
        new = _beat_rows(pdf)
        rows = _per_run(pd.concat([rows, new], ignore_index=True)) if len(rows) else new
    seen, closed = rows["seen"].astype(bool), rows["closed"].astype(bool)
    final = rows["rank"] < NEVER
    quiet = ~seen & (rows["until"] < now)
    told = rows.assign(status=rows["status"].where(~quiet, "stuck"))[(final | quiet) & ~closed]
    if len(told):
        id_ = lambda name, bit: told[name].astype("Int64").mask((told["absent"] & bit) > 0).to_numpy(object, na_value=None)
        yield pd.DataFrame({
            "source_id": id_("source_id", 1), "run_id": id_("run_id", 2), "status": told["status"].to_numpy(), "started_at": pd.to_datetime(told["first"].to_numpy(), unit="us"),
            "last_seen": pd.to_datetime(told["last"].to_numpy(), unit="us"), "beats": told["beats"].to_numpy()})
    until = np.maximum(rows["last"] // 1000 + QUIET_MS, now + 1)
    rows = rows.assign(closed=closed | final, until=rows["until"].where(~seen, until))[~quiet]
    if not len(rows):
        state.remove()
        return
    left = np.empty(len(rows), OPEN_RUN)
    for name in OPEN_RUN.names:
        left[name] = rows[name].to_numpy()
    state.update((left.tobytes(),))
    state.setTimeoutTimestamp(int(max(left["until"].min(), now)))


def run_lifecycle(beats: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Heartbeats (source_id, run_id, ts, status) to ended runs: success, failed, or stuck after an hour of silence.

    State is kept per bucket of runs, dealt by a hash of both ids, so a busy source is spread over the cluster and the Python
    function runs once per bucket and micro-batch, not once per run. A bucket is woken when the first of its runs has been quiet for an hour.
    """
    c = F.col
    absent = c("source_id").isNull().cast("long") + c("run_id").isNull().cast("long") * 2
    rows = beats.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("source_id", "run_id"), F.lit(BUCKETS)).alias("bucket"), F.coalesce(c("source_id").cast("long"), F.lit(0)).alias("source_id"),
        F.coalesce(c("run_id").cast("long"), F.lit(0)).alias("run_id"), absent.alias("absent"), "ts", "status")
    return rows.groupBy("bucket").applyInPandasWithState(_lifecycle, LIFECYCLE, LIFECYCLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def active_conflicts(runs: DataFrame) -> DataFrame:
    """Runs that were open at the same time as an earlier run of their source: there must be none.

    Works on (source_id, run_id, started_at, last_seen) of open and ended runs. The
    latest end of all earlier runs is a running maximum, computed per month and
    carried over, so no source sits in one task.
    """
    from pyspark.sql import Window as W

    c = F.col
    rows = runs.withColumn("_m", F.trunc(c("started_at").cast("date"), "MONTH"))
    months = rows.groupBy("source_id", "_m").agg(F.max("last_seen").alias("_end"))
    before = W.partitionBy("source_id").orderBy("_m").rowsBetween(W.unboundedPreceding, -1)
    carried = months.select("source_id", "_m", F.max("_end").over(before).alias("_carried"))
    inside = W.partitionBy("source_id", "_m").orderBy("started_at", "run_id").rowsBetween(W.unboundedPreceding, -1)
    open_until = F.greatest(F.max("last_seen").over(inside), c("_carried"))
    return rows.join(carried, ["source_id", "_m"]).withColumn("_open", open_until).filter(c("_open") > c("started_at")).drop("_m", "_carried", "_open")
