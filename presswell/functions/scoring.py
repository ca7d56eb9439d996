"""Scores and labels as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswell.config import ENTITY_TYPES, SENTIMENT_LABELS
from presswell.functions.text import strip


def signed_sentiment(label: Column, score: Column) -> Column:
    """+score, -score or 0; a NULL label or score counts 0."""
    score = F.coalesce(score, F.lit(0.0))
    return F.when(label == "positive", score).when(label == "negative", -score).otherwise(0.0)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))[key]


def sentiment_label(raw: Column) -> Column:
    """Numbered labels by name, others in lower case without blanks around."""
    return F.coalesce(_lookup(SENTIMENT_LABELS, raw), F.lower(strip(raw)))


def entity_type(label: Column) -> Column:
    """The kept type of a recogniser's label; NULL if it isn't kept."""
    return _lookup(ENTITY_TYPES, label)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; NULL if one is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def topic_name(topic: Column, words: Column, n: int = 3) -> Column:
    """Default name of a topic: its first words, ``topic_<id>`` without words, a fixed name for -1."""
    return F.when(topic == -1, "outlier_uncategorized").when(F.size(words) > 0, F.concat_ws("_", F.slice(words, 1, n))).otherwise(F.concat(F.lit("topic_"), topic.cast("string")))
