"""Helpers the operators of this folder share: row keys, ordered numbering and the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townhall.session import settle

WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rest(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the documented split into learned and held-out rows (null id: 0)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def row_key(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed; rows that share it are repeats of one row."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def whole_rows(df: DataFrame) -> DataFrame:
    """doc_id, row_key and row, a struct of all columns: whatever these are called, they clash with nothing."""
    return df.select("doc_id", row_key(df).alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def number_in_order(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Positions 0, 1, ... per ``group`` in ``order``, without a task per group.

    Rows are dealt by range over (group, order) and written, rows per partition and group
    are counted (at most partitions + groups numbers), and positions start at the sum of
    the earlier partitions.
    """
    spark = df.sparkSession
    n = partitions(spark)
    dealt = settle(df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()))
    counts = dealt.groupBy(*group, "_pid").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_pid").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = dealt.withColumn("_rn", F.row_number().over(W.partitionBy("_pid", *group).orderBy(*order)))
    same = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # One row per partition and group: at most as many as both together.
    return local.join(F.broadcast(starts), same).select(*df.columns, (F.col("_rn") - 1 + F.col("_start")).alias(out))
