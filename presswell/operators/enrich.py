"""Sentiment, entities and keywords per article, with deterministic default backends.

Each backend is a function of columns or of a DataFrame and can be replaced;
the defaults use a lexicon, patterns and term weights and make no claim to the
accuracy of trained language models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswell.config import ENTITY_MAX_CHARS, NEGATIVE, POSITIVE, STOPWORDS
from presswell.functions.scoring import entity_type
from presswell.functions.text import strip, tokens
from presswell.operators.lookup import looked_up
from presswell.session import materialize

#: Document frequencies of at most so many keywords are sent to the tasks.
MOST_PACKED = 4_000_000


def lexicon_sentiment(text: Column, positive=POSITIVE, negative=NEGATIVE) -> tuple[Column, Column]:
    """(label, score) by the balance of positive and negative words; blank text is neutral with 0."""
    found = tokens(text)
    count = lambda words: F.size(F.filter(found, lambda x: x.isin(list(words))))
    p, n = count(positive), count(negative)
    label = F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")
    return label, F.coalesce(F.try_divide(F.abs(p - n), p + n), F.lit(0.0))


def score_sentiment(articles: DataFrame, backend: Callable[[Column], tuple[Column, Column]] = lexicon_sentiment, name: str = "lexicon") -> DataFrame:
    """(article_id, sentiment, sentiment_score, sentiment_model)."""
    label, score = backend(F.col("content_clean"))
    return articles.select("article_id", label.alias("sentiment"), score.alias("sentiment_score"), F.lit(name).alias("sentiment_model"))


#: Label and pattern of the default recogniser; the first group is the entity.
ENTITY_PATTERNS = [
    ("ORG", r"((?:[A-Z][\w’'-]+ )+(?:Board|Council|Company|Authority|Association|Utility|College|Office|Forum|Union|Secretariat|Commerce|Line|Cooperative))"),
    ("MONEY", r"([£€$][0-9][0-9,.]*(?:m|bn)?|[0-9][0-9,]* million)"),
    ("GPE", r"\b[Ii]n ([A-Z][a-z]+)"),
    ("EVENT", r"the ([A-Z][a-z]+ (?:Regatta|Summit|Trade Fair|Cup Final))"),
]


def pattern_mentions(articles: DataFrame, patterns: list[tuple[str, str]] = ENTITY_PATTERNS) -> DataFrame:
    """(article_id, entity, label) of every match."""

    def matches(label: str, pattern: str) -> Column:
        every = F.regexp_extract_all(F.coalesce("content_clean", F.lit("")), F.lit(pattern), F.lit(1))
        return F.transform(every, lambda x: F.struct(x.alias("entity"), F.lit(label).alias("label")))

    found = F.concat(*(matches(*p) for p in patterns))
    return articles.select("article_id", F.explode(found).alias("m")).select("article_id", "m.entity", "m.label")


def count_entities(mentions: DataFrame) -> DataFrame:
    """(article_id, entity, entity_type, confidence): mentions per article of the kept types; blank ones are left out."""
    kept = mentions.select("article_id", strip(F.col("entity")).alias("entity"), entity_type(F.col("label")).alias("entity_type"))
    kept = kept.where("entity_type is not null and entity <> ''").withColumn("entity", F.substring("entity", 1, ENTITY_MAX_CHARS))
    return kept.groupBy("article_id", "entity", "entity_type").agg(F.count("*").cast("double").alias("confidence"))


def ngrams(text: Column, stopwords=STOPWORDS) -> Column:
    """Words and pairs of successive words, stop words taken out first."""
    words = F.filter(tokens(text), lambda x: ~x.isin(list(stopwords)))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def packed_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, their counts) of ``counts`` (h, df) as two arrays, 12 bytes a row."""
    rows = counts.select("h", F.col("df").cast("int").alias("df")).toArrow()
    hashes, found = rows["h"].to_numpy(), rows["df"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], found[order]


def _first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def keyword_scores(articles: DataFrame, stopwords=STOPWORDS, most: int | None = None, most_packed: int = MOST_PACKED) -> DataFrame:
    """(article_id, keyword, score): TF-IDF of words and pairs over all articles; ``articles`` has each article once.

    With ``most``, at least the rows that ``top_keywords`` of so many can
    give. Document frequencies are counted by 64-bit hashes; only those of
    keywords of two articles or more are kept, the many others have a
    frequency of 1. Up to ``most_packed`` of them are sent packed to the
    tasks, where each article's terms are counted and looked up without any
    shuffle; more are joined.
    """
    placed = articles.select("article_id", ngrams(F.col("content_clean"), stopwords).alias("terms"))
    placed = placed.select("article_id", "terms", F.transform("terms", lambda x: F.xxhash64(x)).alias("h"))
    df = placed.select(F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    df = materialize(df.where("df > 1"), "frequencies")
    n = articles.count()
    if df.count() > most_packed:
        tf = placed.select("article_id", F.explode("terms").alias("keyword")).groupBy("article_id", "keyword").agg(F.count("*").alias("tf"))
        weighted = looked_up(tf.withColumn("h", F.xxhash64("keyword")), df, ["h"], "left")
    else:
        known = articles.sparkSession.sparkContext.broadcast(packed_counts(df))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts = known.value
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    terms, sizes = part.column(1).flatten(), part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                    h, doc = part.column(2).flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
                    order = np.lexsort((h, doc))
                    new = _first_of_each(doc[order], h[order])
                    tf, at = np.diff(new, append=len(h)), order[new]
                    doc, h = doc[at], h[at]
                    found = np.ones(len(h), np.int64)
                    if len(keys):
                        spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                        found = np.where(keys[spot] == h, counts[spot], 1).astype(np.int64)
                    if most and len(h):
                        # no score below the article's most-th can be taken, and of equal ones only the first by keyword
                        score = tf * (np.log((1 + n) / (1 + found)) + 1)
                        down = np.lexsort((-score, doc))
                        begin = _first_of_each(doc[down])
                        last = score[down][np.minimum(begin + most, np.append(begin[1:], len(h))) - 1]
                        kept = np.flatnonzero(score >= np.repeat(last, np.diff(begin, append=len(h))) - 1e-8)
                        place = np.empty(len(kept), np.int64)
                        place[pc.array_sort_indices(terms.take(pa.array(at[kept]))).to_numpy()] = np.arange(len(kept))
                        order = np.lexsort((place, found[kept], tf[kept], doc[kept]))
                        kept = kept[order]
                        same = _first_of_each(doc[kept], tf[kept], found[kept])
                        kept = kept[np.arange(len(kept)) - np.repeat(same, np.diff(same, append=len(kept))) < most]
                        doc, tf, found, at = doc[kept], tf[kept], found[kept], at[kept]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), terms.take(pa.array(at)), pa.array(tf, pa.int64()), pa.array(found)], ["article_id", "keyword", "tf", "df"])

        weighted = placed.mapInArrow(run, "article_id long, keyword string, tf long, df long")
    frequency = F.coalesce("df", F.lit(1).cast("long"))
    return weighted.select("article_id", "keyword", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + frequency)) + 1)).alias("score"))


def top_keywords(scores: DataFrame, n: int = 10) -> DataFrame:
    """The n best keywords of each article with rank from 1; ties by keyword."""
    w = Window.partitionBy("article_id").orderBy(F.desc(F.round("score", 9)), "keyword")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def diverse_keywords(scores: DataFrame, n: int = 10, pool: int = 30, diversity: float = 0.5) -> DataFrame:
    """As ``top_keywords``, picked one after the other for weight and for being unlike those before.

    Among each article's ``pool`` best; likeness is the share of character
    trigrams in common.
    """

    def pick(found) -> Iterator[tuple[str, float]]:
        bit: dict[str, int] = {}
        words, weights, grams = [x["keyword"] for x in found], [float(x["score"]) for x in found], []
        for word in words:
            padded, mask = f"  {word} ", 0
            for i in range(len(padded) - 2):
                mask |= 1 << bit.setdefault(padded[i : i + 3], len(bit))
            grams.append(mask)
        top = max(weights, default=1.0) or 1.0
        like, left = [0.0] * len(words), list(range(len(words)))  # like: the greatest likeness to those chosen
        for _ in range(min(n, len(words))):
            best = max(left, key=lambda k: ((1 - diversity) * weights[k] / top - diversity * like[k], weights[k], words[k]))
            left.remove(best)
            yield words[best], weights[best]
            for k in left:
                common = (grams[k] & grams[best]).bit_count()
                if common:
                    like[k] = max(like[k], common / (grams[k] | grams[best]).bit_count())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(article, *x, k) for article, found in zip(frame["article_id"], frame["pool"], strict=True) for k, x in enumerate(pick(found), 1)]
            yield pd.DataFrame(rows, columns=["article_id", "keyword", "score", "rank"])

    best = top_keywords(scores, pool).groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("rank", "keyword", "score"))).alias("pool"))
    return best.mapInPandas(run, "article_id long, keyword string, score double, rank int")
