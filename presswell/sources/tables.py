"""Readers of the tables and of side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, null_value: str = "NULL") -> DataFrame:
    """Header CSV with doubled quotes inside quoted fields and a NULL word."""
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("nullValue", null_value)
        .option("mode", "PERMISSIVE")
        .schema(schema)
        .csv(path)
    )


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{"3": "name"}`` as rows (topic_id, topic_name)."""
    text = spark.read.option("wholetext", True).text(path)
    entries = F.explode(F.from_json("value", "map<string,string>")).alias("topic_id", "topic_name")
    return text.select(entries).select(F.col("topic_id").cast("int"), "topic_name")


def read_sql_script(text: str) -> list[str]:
    """Statements of a SQL script: comment lines go first, then a split at ``;``."""
    kept = "\n".join(line for line in text.splitlines() if not line.strip().startswith("--"))
    return [s.strip() for s in kept.split(";") if s.strip()]
