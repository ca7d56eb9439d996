"""Problem 4: trailing weekly averages per series and daily totals per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.operators.current import newest_values
from presswell.operators.rolling import densify, trailing, week_monday
from presswell.sources.tables import read_table


def weekly_averages(panel: DataFrame) -> DataFrame:
    """Each series and calendar week with ``right_4`` and ``right_8`` beside the stored averages.

    Restated rows: the greatest ``computed_at`` counts. Idle weeks are present
    with ``present`` false. A NULL count adds nothing. Rows without a series
    or with a week that is not an ISO week are dropped. Columns of other names
    are ignored.
    """
    values = [F.col(c) for c in ("article_count", "ma_4week", "ma_8week")]
    current = newest_values(panel, ["series", "week"], "computed_at", values)
    current = current.withColumns({"monday": week_monday(F.col("week")), "present": F.lit(True)})
    dense = densify(current, ["series"], "monday", step="week")
    sums = trailing(dense, ["series"], "monday", "article_count", [4, 8])
    for n in (4, 8):
        sums = sums.withColumn(f"right_{n}", F.when(F.col(f"full_{n}"), F.col(f"total_{n}") / n))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "monday").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("monday").cast("string"), 2, "0"))
    return sums.select(
        "series", week.alias("week"), F.coalesce("present", F.lit(False)).alias("present"), "article_count",
        "right_4", "right_8", "ma_4week", "ma_8week",
    )


def _wrong(stored: Column, right: Column, tolerance: float = 0.01) -> Column:
    return F.coalesce(F.abs(stored - right) > tolerance, stored.isNull() != right.isNull()) | F.isnan(F.coalesce(stored, F.lit(0.0)))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = weekly_averages(read_table(spark, folder, "temporal_features")).where("present")
    wrong = _wrong(F.col("ma_4week"), F.col("right_4")) | _wrong(F.col("ma_8week"), F.col("right_8"))
    return rows.where(wrong).select("series", "week")


def p4_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """All calendar weeks of all series, idle ones included."""
    rows = weekly_averages(read_table(spark, folder, "temporal_features"))
    rounded = {c: F.round(c, 6) for c in ("right_4", "right_8", "ma_4week", "ma_8week")}
    return rows.withColumns(rounded)


def _name() -> Column:
    return F.lower(F.trim(F.regexp_replace("entity", r"\s+", " ")))


def entity_days(entities: DataFrame, processed: DataFrame) -> DataFrame:
    """Mentions per entity and ``publication_date`` of the mentioning article's current row.

    An entity is its name in lower case with white space collapsed. A repeated
    row (all columns equal) counts once; mentions by articles unknown or
    without a date are left out. Counts are taken per day before any calendar
    is made, so a hot entity shuffles no more than one row per day and task.
    """
    mentions = entities.select("article_id", "entity", "entity_type", "confidence").distinct().select("article_id", _name().alias("entity"))
    dates = newest_values(processed, ["article_id"], "processing_timestamp", [F.col("publication_date")])
    return mentions.join(dates, "article_id").where("publication_date is not null and entity <> ''").groupBy("entity", "publication_date").agg(F.count("*").alias("mentions"))


def _entity_totals(dense: DataFrame) -> DataFrame:
    sums = trailing(dense, ["entity"], "publication_date", "mentions", [7, 30])
    return sums.select(
        "entity", "publication_date", F.coalesce("mentions", F.lit(0)).alias("mentions"), "total_7", "total_30",
        F.round(F.col("total_7") / 7, 6).alias("average_7"), F.round(F.col("total_30") / 30, 6).alias("average_30"),
    )


def _span(processed: DataFrame) -> tuple[Column, Column]:
    """First and last publication date of all current rows."""
    dates = newest_values(processed, ["article_id"], "processing_timestamp", [F.col("publication_date")])
    first, last = dates.agg(F.min("publication_date"), F.max("publication_date")).first()
    return F.lit(first).cast("date"), F.lit(last).cast("date")


def entity_calendar(entities: DataFrame, processed: DataFrame) -> DataFrame:
    """Totals and averages over 7 and 30 days of every entity on every day from the first to the last ``publication_date``.

    The days are those of all current rows, with mentions or without, and are
    the same for each entity. An entity without a dated mention has zeros.
    """
    first, last = _span(processed)
    every = entities.select(_name().alias("entity")).where("entity <> ''").distinct()
    days = entity_days(entities, processed).unionByName(every.select("entity", first.alias("publication_date"), F.lit(0).alias("mentions")))
    days = days.groupBy("entity", "publication_date").agg(F.sum("mentions").alias("mentions"))
    return _entity_totals(densify(days, ["entity"], "publication_date", first=first, last=last))


def p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and averages over 7 and 30 days on each day from an entity's first mention to the last day of the table.

    Days before an entity's first mention have zeros and are left out; ``p4_entity_days`` has them too.
    """
    processed = read_table(spark, folder, "processed_news")
    days = entity_days(read_table(spark, folder, "article_entities"), processed)
    return _entity_totals(densify(days, ["entity"], "publication_date", last=_span(processed)[1]))


def p4_entity_days(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every entity and day of the table."""
    return entity_calendar(read_table(spark, folder, "article_entities"), read_table(spark, folder, "processed_news"))
