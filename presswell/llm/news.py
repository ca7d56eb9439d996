"""The news tables as the problems of this package see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.operators.current import newest_rows
from presswell.sources.tables import read_table


def completed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, text, ..): current processed rows that are COMPLETED."""
    columns = ("article_id", "processing_timestamp", "processing_status", "content_clean", "article_length_words", "sentence_count")
    rows = read_table(spark, folder, "processed_news").select(*columns)
    current = newest_rows(rows, ["article_id"], "processing_timestamp").where("processing_status = 'COMPLETED'")
    return current.select(F.col("article_id").alias("doc"), F.col("content_clean").alias("text"), "article_length_words", "sentence_count")


def current_scraped(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current rows of scraped_news: id and the asked columns."""
    rows = read_table(spark, folder, "scraped_news").select("id", "scraped_at", *columns)
    return newest_rows(rows, ["id"], "scraped_at").select("id", *columns)
