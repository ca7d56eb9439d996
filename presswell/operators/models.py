"""Models behind Arrow batches: the hook by which scorers, recognisers, extractors and embedders are plugged in."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from presswell.functions.scoring import sentiment_label
from presswell.operators.enrich import top_keywords

SENTIMENT, ENTITIES, KEYWORDS, VECTOR = "label string, score double", "array<struct<entity:string,label:string>>", "array<struct<keyword:string,score:double>>", "array<double>"


class BatchModel(NamedTuple):
    """``load`` runs once per task, where the executor is, and gives ``predict``: texts to as many results.

    ``result`` is the type of one result; of a struct it lists the fields, and
    predict gives tuples. ``size`` texts at most are predicted at once. NULL
    and blank texts don't reach the model and have a NULL result.
    """

    load: Callable[[], Callable[[list[str]], list]]
    result: str
    size: int = 32


def predicted(text: Column, model: BatchModel) -> Column:
    """The model's result for each text, by a pandas UDF over Arrow batches."""
    kind = _parse_datatype_string(model.result)
    fields = kind.fieldNames() if isinstance(kind, StructType) else None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = model.load()
        for batch in batches:
            texts = batch.tolist()
            full = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            out: list = [None] * len(texts)
            for at in range(0, len(full), model.size):
                part = full[at : at + model.size]
                found = predict([texts[i] for i in part])
                if len(found) != len(part):
                    raise ValueError(f"the model gave {len(found)} results for {len(part)} texts")
                for i, r in zip(part, found, strict=True):
                    out[i] = r
            yield pd.DataFrame([r if r is not None else (None,) * len(fields) for r in out], columns=fields) if fields else pd.Series(out, dtype=object)

    if fields:

        def typed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from run(batches)
    else:

        def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from run(batches)

    typed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame if fields else pd.Series]}
    return F.pandas_udf(typed, kind)(text)


def sentiment_backend(model: BatchModel) -> Callable[[Column], tuple[Column, Column]]:
    """A backend of ``score_sentiment``; texts without a result are neutral with 0."""

    def backend(text: Column) -> tuple[Column, Column]:
        found = predicted(text, model)
        return F.coalesce(sentiment_label(found["label"]), F.lit("neutral")), F.coalesce(found["score"], F.lit(0.0))

    return backend


def model_mentions(articles: DataFrame, model: BatchModel) -> DataFrame:
    """(article_id, entity, label) of every mention, for ``count_entities``."""
    found = articles.select("article_id", F.explode(predicted(F.col("content_clean"), model)).alias("m"))
    return found.select("article_id", "m.entity", "m.label")


def model_keywords(articles: DataFrame, model: BatchModel, n: int = 10) -> DataFrame:
    """(article_id, keyword, score, rank) of the n best keywords."""
    found = articles.select("article_id", F.explode(predicted(F.col("content_clean"), model)).alias("k"))
    return top_keywords(found.select("article_id", "k.keyword", "k.score"), n)


def embedded(rows: DataFrame, model: BatchModel, text: str = "text") -> DataFrame:
    """``rows`` with their text's vector; NULL for blank texts."""
    return rows.withColumn("vector", predicted(F.col(text), model))


def hashed_vectors(size: int = 256) -> BatchModel:
    """The default embedder: words hashed to signed places, weighted by 1 + ln of their count, of norm 1.

    It knows no meaning, only words; a language model takes its place.
    """

    def load() -> Callable[[list[str]], list]:
        word = re.compile(r"[^\W_]{2,}")

        def predict(texts: list[str]) -> list:
            out = []
            for text in texts:
                found, n = np.unique([zlib.crc32(w.encode()) for w in word.findall(text.lower())], return_counts=True)
                found = found.astype(np.int64)
                v = np.bincount(found % size, weights=(1 + np.log(n)) * np.where(found >> 16 & 1, 1.0, -1.0), minlength=size) if len(found) else np.zeros(size)
                out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
            return out

        return predict

    return BatchModel(load, VECTOR, 256)
