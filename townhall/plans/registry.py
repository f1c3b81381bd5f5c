"""Collects the queries: key -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall.plans.fixtures import table, view, view_over
from townhall.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Access to base tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def wide(self, name: str, base: str = "orders") -> DataFrame:
        """A derived view for work that is heavy per row: the thin rows of its base table are dealt out evenly first."""
        return view_over(self.spark, self.sf_dir, name, **{base: dealt(self.table(base))})

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def dealt(base: DataFrame) -> DataFrame:
    """Rows over all shuffle partitions if their files have fewer splits than the cluster has cores. Views make the wide columns afterwards."""
    if base.rdd.getNumPartitions() >= base.sparkSession.sparkContext.defaultParallelism:
        return base
    return base.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def query(key: str, sql: str | None = None):
    """Register ``fn(source)`` under ``key`` with its oracle."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Source(prepare(spark), sf_dir))

        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return fn

    return wrap


def stamp(c: Column) -> Column:
    """Timestamps leave as text, so that no client re-reads them in another zone."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
