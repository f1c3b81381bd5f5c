"""Joins against a one-row-per-key table when some keys are very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FEW_ROWS = 200_000


def by_key(df: DataFrame) -> DataFrame:
    """The other side of a join, dealt out by key on both sides and never broadcast.

    For sides with a row per article or item. Their rows repeat each other, so written or shuffled they are a small part of what
    the driver and every task would hold in memory, and the planner, which sees those bytes, would broadcast millions of rows.
    """
    return df.hint("merge")


def by_rows(df: DataFrame) -> DataFrame:
    """A written table as the other side of a join: dealt out by key unless it has few rows. Its footers are read, not its rows."""
    return df if df.count() <= FEW_ROWS else by_key(df)


def key_id(*keys: Column) -> list[Column]:
    """Two numbers, 128 bits of hashes, that stand for the values of a key where only equality counts: columns _id0 and _id1. Nulls are values like others.

    Long keys of text are dealt out and sorted as these numbers. Both sides of a join need one type per key, and no floats.
    """
    parts = [p for k in keys for p in (k.isNull(), k)]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"_id{i}") for i, seed in enumerate(("first", "second"))]


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", spread: str | None = None, salts: int = 1) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key (inner or left).

    Only the left side can be skewed. With ``salts`` = 1 a hot key is split at run
    time: the session turns on skew-join splitting and forces it also where it costs
    an extra exchange, and the small side of a split is read again, not the input.
    With more salts the rows of every key are spread by a hash of ``spread`` over
    that many tasks and the right side is repeated as often; use it where a hot key
    is known beforehand and the right side is narrow.
    """
    if salts <= 1:
        return left.join(right, keys, how)
    if spread is None:
        raise ValueError("salting needs a column to spread by")
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
