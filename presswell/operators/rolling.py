"""Trailing totals over a dense calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_monday(week: Column) -> Column:
    """Monday of an ISO week written ``YYYY-Www``; NULL for any other text."""
    ok = week.rlike(r"^[0-9]{4}-W(0[1-9]|[1-4][0-9]|5[0-3])$")
    year, number = F.substring(week, 1, 4).try_cast("int"), F.substring(week, 7, 2).try_cast("int")
    fourth = F.make_date(F.when(ok, year), F.lit(1), F.lit(4))
    return F.date_add(F.trunc(fourth, "week"), 7 * (number - 1))


def densify(daily: DataFrame, entity: list[str], at: str, step: str = "day", first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Every entity's calendar from ``first`` to ``last``, joined with what it has.

    By default an entity's calendar runs from its own first to its own last
    date. The calendar is made by ``explode(sequence(..))`` per entity, so
    there is no join without a key, and one entity's calendar is as long as
    the time covered, however many rows the entity has. ``daily`` must hold
    one row per entity and date (dates of one weekday if the step is a week);
    rows with a NULL entity or date are dropped. Idle dates get NULL values.
    """
    known = [F.col(c).isNotNull() for c in [*entity, at]]
    for k in known:
        daily = daily.where(k)
    span = daily.groupBy(*entity).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    begin = F.col("__first") if first is None else first
    end = F.col("__last") if last is None else last
    every = F.expr("interval 1 day" if step == "day" else "interval 7 days")
    dates = F.when(begin <= end, F.sequence(begin, end, every))
    calendar = span.select(*entity, F.explode(dates).alias(at))
    return calendar.join(daily, [*entity, at], "left")


def trailing(dense: DataFrame, entity: list[str], at: str, value: str, sizes: list[int], prefix: str = "total_") -> DataFrame:
    """Totals of ``value`` over the last n calendar rows of each entity, for every n.

    ``<prefix>n`` counts idle rows (NULL values) as 0, ``full_n`` tells whether
    the n rows lie within the entity's calendar.
    """
    w = Window.partitionBy(*entity).orderBy(at)
    filled = F.coalesce(F.col(value), F.lit(0))
    out = dense.withColumn("__row", F.row_number().over(w))
    for n in sizes:
        out = out.withColumn(f"{prefix}{n}", F.sum(filled).over(w.rowsBetween(1 - n, 0))).withColumn(f"full_{n}", F.col("__row") >= n)
    return out.drop("__row")
