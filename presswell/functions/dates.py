"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswell.functions.text import strip
from presswell.operators.rolling import week_monday

__all__ = ["date_columns", "date_pattern", "iso_week", "parse_date", "week_monday"]


def parse_date(raw: Column) -> Column:
    """``1 Apr 2026`` (one or two digits, three letters, four digits); anything else, impossible dates too, is NULL."""
    text = F.regexp_replace(strip(raw), r"(?U)\s+", " ")
    fits = text.rlike(r"^(?i)[0-9]{1,2} [a-z]{3} [0-9]{4}$")
    return F.to_date(F.try_to_timestamp(F.when(fits, text), F.lit("d MMM yyyy")))


def iso_week(date: Column) -> Column:
    """``YYYY-Www`` by ISO year and week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def date_columns(raw: str) -> dict[str, Column]:
    """The date columns of a processed article from its raw date; all NULL if it can't be read."""
    date = parse_date(F.col(raw))
    return {
        "published_at": date.cast("timestamp_ntz"),
        "publication_date": date,
        "publication_year": F.year(date),
        "publication_month": F.month(date),
        "publication_week": iso_week(date),
        "publication_day": F.dayofmonth(date),
        "date_parse_status": F.when(date.isNotNull(), "OK").otherwise("FAILED"),
    }


# Names and patterns of the spellings of raw dates; the first that fits counts.
DATE_PATTERNS = [
    ("ISO_DATE (YYYY-MM-DD...)", r"(?d)^[0-9]{4}-[0-9]{2}-[0-9]{2}.*$"),
    ("N hours ago", r"(?iU)^[0-9]+\s+hours?\s+ago$"),
    ("N days ago", r"(?iU)^[0-9]+\s+days?\s+ago$"),
    ("N minutes ago", r"(?iU)^[0-9]+\s+minutes?\s+ago$"),
    ("Yesterday/Today keyword", r"(?i)^(yesterday|today)$"),
    ("Month DD, YYYY", r"(?U)^[A-Za-z]+\s+[0-9]{1,2},?\s+[0-9]{4}$"),
    ("EMPTY/NULL", r"(?i)^(none|nan)?$"),
]


def date_pattern(raw: Column) -> Column:
    """The kind of spelling of a raw date without white space around it; NULL counts as empty."""
    text = strip(raw)
    out = F.when(raw.isNull(), "EMPTY/NULL")
    for name, pattern in DATE_PATTERNS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("OTHER/UNRECOGNIZED")
