"""The newest row of each key, without shuffling wide rows twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*columns: str) -> Column:
    """A 64-bit hash of the columns in which NULL differs from every value."""
    parts = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*parts)


def newest_values(df: DataFrame, keys: list[str], order: str, values: list[Column]) -> DataFrame:
    """One row per key with ``values`` of the row that has the greatest ``order``.

    A partial aggregate runs before the shuffle, so repeats and old versions
    are dropped early; meant for narrow values (numbers, hashes). Rows with a
    NULL key are dropped, a NULL ``order`` sorts before any other, and rows
    tied on ``order`` are decided by the greatest values, so results repeat.
    """
    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    packed = F.max(F.struct(F.col(order).alias("__order"), *values)).alias("__newest")
    names = [n for n in df.select(*values).columns]
    return df.where(known).groupBy(*keys).agg(packed).select(*keys, *(F.col(f"__newest.`{n}`").alias(n) for n in names))


def newest_rows(df: DataFrame, keys: list[str], order: str, tie: Column | None = None) -> DataFrame:
    """The whole newest row of each key, by a window over the key.

    For wide rows: the window holds one key's versions, never a hot value.
    Ties on ``order`` fall to ``tie`` (default: a hash of all columns).
    """
    tie = F.xxhash64(*df.columns) if tie is None else tie
    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    # the tie is worked out before the shuffle, so columns nobody asks for stay behind
    marked = df.where(known).withColumn("__tie", tie)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col("__tie").desc())
    return marked.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "__tie")
