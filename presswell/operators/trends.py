"""Backward-looking trend columns of a weekly panel.

Windows run over weeks that are present, not over the calendar. A panel of one
series is a few hundred rows after aggregation; with ``series`` the windows
are partitioned, and nothing here ever runs over article rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswell.config import ENTITY_GROUPS, KEYWORD_GROUPS, TOPIC_GROUPS


def ordered(series: list[str] | None):
    return Window.partitionBy(*series).orderBy("week") if series else Window.orderBy("week")


def pct_change(value: Column, w) -> Column:
    """Relative change to the row before; NULL if that is 0 or missing."""
    before = F.lag(value).over(w)
    return F.try_divide(value.cast("double") - before, before.cast("double"))


def moving_average(value: Column, n: int, w) -> Column:
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def add_trends(panel: DataFrame, series: list[str] | None = None, groups: tuple = (TOPIC_GROUPS, KEYWORD_GROUPS, ENTITY_GROUPS)) -> DataFrame:
    w = ordered(series)
    total = lambda columns: reduce(lambda a, b: a + b, (F.col(c) for c in columns))
    topic, keyword, entity = (total(g) for g in groups)
    return panel.withColumns({
        "article_count_change": pct_change(F.col("article_count"), w),
        "sentiment_change": F.col("average_sentiment") - F.lag("average_sentiment").over(w),
        "topic_growth_rate": pct_change(topic, w), "keyword_growth_rate": pct_change(keyword, w), "entity_growth_rate": pct_change(entity, w),
        "ma_4week": moving_average(F.col("article_count"), 4, w), "ma_8week": moving_average(F.col("article_count"), 8, w),
    })
