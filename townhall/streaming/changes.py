"""A change feed between two versions of a table, and the job that reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.operators import merge
from townhall.streaming.jobs import Snapshots

FEED = "article_id bigint, kind string, epoch bigint"


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and the kind of every difference: ``added``, ``changed`` or ``removed``. Null values and null keys are equal to each other.

    Rows are compared by key and a hash of the rest, so only thin rows meet: rows of either version that the other lacks (EXCEPT both
    ways) are grouped by key. ``keys`` are unique in both versions; columns are those of ``new``, in any order.
    """
    rest = [c for c in new.columns if c not in keys]
    thin = lambda df: df.select(*keys, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias("_digest"))
    was, now = thin(old), thin(new)
    sides = now.exceptAll(was).select(*keys, F.lit(1).alias("_now"), F.lit(0).alias("_was")).unionByName(
        was.exceptAll(now).select(*keys, F.lit(0).alias("_now"), F.lit(1).alias("_was")))
    kind = F.when(F.max("_was") == 0, "added").when(F.max("_now") == 0, "removed").otherwise("changed")
    return sides.groupBy(*keys).agg(kind.alias("kind"))


def with_feed(each: Callable[[DataFrame, int], None], store: Snapshots, table: str, schema: str, keys: list[str], feed: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that runs ``each`` and then writes what it changed in ``table`` below ``feed``, one folder per epoch.

    A repeated batch overwrites its folder; a reader of the feed that has seen it meets the same rows again, which its own merge takes.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        each(batch, epoch)
        spark = batch.sparkSession
        found = changes(store.read(spark, table, epoch - 1, schema), store.read(spark, table, epoch, schema), keys)
        found.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{feed}/epoch-{epoch:012d}")

    return run


MEASURES = "article_id bigint, n_passes bigint, n_chars bigint, n_words bigint"


def measure_changed(store: Snapshots, bodies: Callable[[], DataFrame], target: str = "measures"):
    """foreachBatch handler over the feed: texts of changed articles are read and measured again, those of removed ones go.

    ``n_passes`` counts the passes over an article. Only texts whose id is in the batch are touched.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("article_id").agg(F.max_by("kind", "epoch").alias("kind"), F.count("*").alias("n"))
        store.write(last, "touched", epoch)
        last = spark.read.parquet(store.path("touched", epoch))
        old = store.read(spark, target, epoch - 1, MEASURES)
        texts = bodies().select("article_id", "cleaned_text").join(last.filter("kind <> 'removed'").select("article_id"), "article_id", "left_semi")
        fresh = texts.select("article_id", F.length("cleaned_text").cast("long").alias("n_chars"), F.size(F.regexp_extract_all("cleaned_text", F.lit(r"\S+"), F.lit(0))).cast("long").alias("n_words"))
        passes = last.select("article_id", "n").join(old.select("article_id", "n_passes"), "article_id", "left").select("article_id", (F.col("n") + F.coalesce("n_passes", F.lit(0))).alias("n_passes"))
        rows = fresh.join(passes, "article_id").select("article_id", "n_passes", "n_chars", "n_words")
        store.write(merge.replace_groups(old, rows, ["article_id"], last.select("article_id")), target, epoch)
        store.prune(spark, (target, "touched"), epoch)

    return each
