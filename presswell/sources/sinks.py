"""Writers of tables and side files."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV, NULL as the word NULL, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "NULL").csv(path)


def write_name_map(names: DataFrame, path: str, most: int = 100_000) -> None:
    """(topic_id, topic_name) as one JSON object; the number of topics is checked."""
    rows = names.select("topic_id", "topic_name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    text = json.dumps({str(r.topic_id): r.topic_name for r in sorted(rows)}, ensure_ascii=False)
    names.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_script(spark: SparkSession, statements: list[str]) -> None:
    for statement in statements:
        spark.sql(statement)
