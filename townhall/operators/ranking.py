"""Positions and surrogate ids that do not put a large group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townhall.operators.skew import by_key
from townhall.session import settle

ID_BUCKETS = 4096  # three hex digits of the key hash


def rank_in_buckets(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Row number per ``keys`` in ``order``, computed bucket by bucket.

    ``bucket`` must be a leading part of the order (smaller bucket, earlier row).
    The rows are written once and read twice, so what they come from runs once. They are counted
    per (keys, bucket) with map-side combine, the counts are accumulated, and only rows of
    one bucket meet in one task.
    """
    staged = settle(df.withColumn("_bucket", bucket))
    counts = staged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = staged.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    offsets = offsets.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate([*keys, "_bucket"])], "_offset")
    same = F.lit(True)
    for i, k in enumerate([*keys, "_bucket"]):
        same &= F.col(k).eqNullSafe(F.col(f"_o{i}"))
    return ranked.join(by_key(offsets), same).select(*df.columns, (F.col("_rn") + F.col("_offset")).alias(out))


def number_rows(df: DataFrame, key: Column, out: str, start: Column | int = 0) -> DataFrame:
    """Consecutive ids ``start + 1 ...`` in the order of sha1(key); ``key`` is unique text.

    The first three hex digits of the hash are the bucket, so buckets are even
    whatever the keys look like, and the offsets table has at most 4096 rows.
    """
    staged = df.withColumn("_h", F.sha1(key.cast("binary"))).withColumn("_bucket", F.substring("_h", 1, 3))
    counts = staged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    base = F.lit(start) if isinstance(start, int) else start
    return (
        staged.withColumn("_rn", F.row_number().over(W.partitionBy("_bucket").orderBy("_h")))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_rn") + F.col("_offset") + base)
        .drop("_h", "_bucket", "_rn", "_offset")
    )
