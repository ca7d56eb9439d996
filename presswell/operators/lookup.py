"""Joins of many rows with a table of different keys, whatever the keys' frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of at most so many narrow rows is broadcast.
MOST_BROADCAST = 500_000


def small(table: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether a count proves that ``table`` has at most ``most`` rows."""
    return table.limit(most + 1).count() <= most


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", salts: int = 16, most: int = MOST_BROADCAST) -> DataFrame:
    """``rows`` joined (inner, left, left_semi or left_anti) with ``table``, in which each key occurs once.

    A small table is broadcast, behind a count. A larger one is copied once
    per salt and joined on key and salt, so a key that a third of the rows
    have is spread over ``salts`` tasks. ``table`` is read twice: pass a
    written one or one that is cheap to make.
    """
    if small(table, most):
        return rows.join(F.broadcast(table), on, how)
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return salted.join(spread, [*on, "__salt"], how).drop("__salt")
