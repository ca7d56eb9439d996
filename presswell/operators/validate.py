"""Validation of raw articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.config import MIN_CONTENT_CHARS
from presswell.functions.text import strip


def failure(least: int = MIN_CONTENT_CHARS) -> Column:
    """The first rule an article breaks, '' if none: a missing field, no title, no content, content too short."""
    rules = None
    for field in ("id", "title", "content", "date", "link"):
        hit = F.col(field).isNull()
        rules = F.when(hit, f"MISSING_FIELD:{field}") if rules is None else rules.when(hit, f"MISSING_FIELD:{field}")
    size = F.char_length(strip(F.col("content")))
    rules = rules.when(strip(F.col("title")) == "", "EMPTY_TITLE").when(size == 0, "EMPTY_CONTENT")
    return rules.when(size < least, F.concat(F.lit("CONTENT_TOO_SHORT:"), size.cast("string"), F.lit("chars"))).otherwise("")


def validate(raw: DataFrame, least: int = MIN_CONTENT_CHARS) -> DataFrame:
    """``raw`` with reason ('' for valid rows) and is_valid; extra columns are kept."""
    return raw.withColumn("reason", failure(least)).withColumn("is_valid", F.col("reason") == "")
