"""Schemas of the tables and statements that create them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.config import ENTITY_GROUPS, KEYWORD_GROUPS, TOPIC_GROUPS
from presswell.plans.pipeline import PROCESSED, RAW_SCHEMA

_PANEL = (
    "week string, article_count int, average_sentiment double, negative_sentiment_ratio double, positive_sentiment_ratio double, "
    "article_count_change double, sentiment_change double, topic_growth_rate double, keyword_growth_rate double, entity_growth_rate double, "
    "ma_4week double, ma_8week double, anomaly_score double, crisis_event int, days_to_crisis int, label_pre_crisis int, "
    + ", ".join(f"{c} int" for c in [*TOPIC_GROUPS, *KEYWORD_GROUPS, *ENTITY_GROUPS])
)

#: Table name: (columns, key columns).
TABLES: dict[str, tuple[str, list[str]]] = {
    "scraped_news": (RAW_SCHEMA, ["id"]),
    "processed_news": (PROCESSED, ["article_id"]),
    "article_sentiment": ("article_id long, sentiment string, sentiment_score double, sentiment_model string", ["article_id"]),
    "article_topics": ("article_id long, topic_id int, topic_name string, topic_probability double", ["article_id", "topic_id"]),
    "article_keywords": ("article_id long, keyword string, score double, rank int", ["article_id", "rank"]),
    "article_entities": ("article_id long, entity string, entity_type string, confidence double", ["article_id", "entity", "entity_type"]),
    "crisis_events": ("event_id int, event_name string, crisis_type string, start_date date, end_date date, description string", ["event_id"]),
    "temporal_features": (_PANEL, ["week"]),
    "processing_log": ("article_id long, step int, stage string, status string, message string", []),
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name][0])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the table's column order and types; missing columns are NULL, others are left out."""
    schema = empty_table(df.sparkSession, name).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def create_statements(folder: str) -> list[str]:
    """DDL for every table as Parquet below a folder; running it again changes nothing.

    Parquet has no indexes; processed articles are laid out by month instead,
    which is what scans by date prune on.
    """
    out = []
    for name, (columns, _) in TABLES.items():
        listed = ", ".join(f"`{c.split()[0]}` {c.split()[1].replace('long', 'bigint')}" for c in columns.split(", "))
        layout = " PARTITIONED BY (publication_year, publication_month)" if name == "processed_news" else ""
        out.append(f"CREATE TABLE IF NOT EXISTS {name} ({listed}) USING parquet{layout} LOCATION '{folder}/{name}'")
    return out


def create_tables(spark: SparkSession, folder: str) -> None:
    for statement in create_statements(folder):
        spark.sql(statement)
