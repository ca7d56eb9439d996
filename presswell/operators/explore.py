"""Summaries for looking at the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def null_and_empty(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, empties) in one pass."""
    sums = [x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}__n"), F.count_if(F.trim(F.col(c)) == "").alias(f"{c}__e"))]
    parts = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("nulls"), F.col(f"{c}__e").alias("empties")) for c in columns))
    return rows.agg(*sums).select(F.explode(parts).alias("x")).select("x.*")


def shares(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, percent); the window runs over one row per value."""
    counted = value_counts(rows, column)
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


def pivot_ratio(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Per key the share of each value among the given ones; keys without any have NULL."""
    counts = rows.groupBy(key).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))
    total = sum((F.col(v) for v in values), F.lit(0))
    return counts.select(key, *(F.round(F.try_divide(F.col(v), total), 6).alias(v) for v in values))


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the order of a seeded hash of the key: the same ones each time."""
    mark = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)
    return rows.withColumn("mark", mark).orderBy("mark").limit(n).drop("mark")


def length_summary(rows: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample standard deviation, least, quartiles and greatest of a numeric column; quartiles between two values are interpolated."""
    c = F.col(column)
    quarter = lambda q: F.percentile(c, q)
    return rows.agg(
        F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("deviation"), F.min(c).alias("least"),
        quarter(0.25).alias("lower_quartile"), F.median(c).alias("median"), quarter(0.75).alias("upper_quartile"), F.max(c).alias("greatest"),
    )


def categories(column: Column, names: dict, default: str) -> Column:
    """A value's category by ``names``; ``default`` for NULL and for values that have none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, name in names.items():
        out = out.when(column == value, name)
    return out.otherwise(default)


def histogram(rows: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n): equal bins from the least to the greatest value, the last one closed."""
    span = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))  # one row
    at = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")) * bins))
    return rows.where(F.col(column).isNotNull()).join(F.broadcast(span)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
