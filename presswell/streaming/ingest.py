"""Articles as they arrive: cleaning in the stream, duplicates and upsert per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presswell.operators.store import VersionedTable
from presswell.plans.pipeline import PROCESSED, RAW_SCHEMA, new_rows


def read_articles(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Raw articles from the JSON files that appear in a folder."""
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def processed_table(spark: SparkSession, path: str) -> VersionedTable:
    """The processed articles at ``path``, by article."""
    return VersionedTable(spark, path, PROCESSED, ["article_id"])


def process_stream(articles: DataFrame, table: str, checkpoint: str, log: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keep the processed table at ``table`` (see ``processed_table``) up to date with a stream of raw articles.

    Each micro-batch is judged against the table and adds its own rows, which
    replace those of the same articles; the rest of the table is not written
    again. A batch's number is committed with its rows, so one that is run
    again after a failure is left out, and a crash between any two steps
    leaves the table of the batch before.
    """

    def step(batch: DataFrame, number: int) -> None:
        target = processed_table(batch.sparkSession, table)
        rows, logged = new_rows(batch.dropDuplicates(["id"]), target.read())
        target.upsert(rows, number)
        if log:
            log(logged)

    return articles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_events(events: DataFrame, at: str = "ts", late: str = "7 days") -> DataFrame:
    """(week_start, event_type, n, total) per Monday-to-Sunday week; with a stream, weeks close ``late`` after their end.

    Windows of a week start on Thursdays by the epoch; four days set them to Mondays.
    """
    stamped = events.withColumn("__at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("__at", late)
    week = F.window("__at", "1 week", "1 week", "4 days")
    return stamped.groupBy(week.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").cast("date").alias("week_start"), "event_type", "n", "total"
    )
