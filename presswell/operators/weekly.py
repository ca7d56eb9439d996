"""The weekly panel: counts, ratios and tracked frequencies per ISO week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.config import ENTITY_GROUPS, KEYWORD_GROUPS, TOPIC_GROUPS
from presswell.functions.scoring import signed_sentiment


def population(processed: DataFrame) -> DataFrame:
    """Articles that count: COMPLETED, no exact duplicates (a NULL status is none that counts), with a week."""
    return processed.where("processing_status = 'COMPLETED' and duplicate_status <> 'EXACT_DUPLICATE' and publication_week is not null")


def article_dataset(processed: DataFrame, sentiment: DataFrame, topics: DataFrame) -> DataFrame:
    """One row per article (more if it has several topics) with week, sentiment and topic; unscored articles stay."""
    base = population(processed).select("article_id", "publication_week")
    return base.join(sentiment.select("article_id", "sentiment", "sentiment_score"), "article_id", "left").join(topics.select("article_id", "topic_name"), "article_id", "left")


def child_dataset(processed: DataFrame, child: DataFrame, column: str) -> DataFrame:
    """(article_id, publication_week, column) of a table of enrichments."""
    return child.select("article_id", column).join(population(processed).select("article_id", "publication_week"), "article_id")


def base_metrics(articles: DataFrame, topic_groups: dict[str, list[str]] = TOPIC_GROUPS) -> DataFrame:
    """Per week: articles, mean signed sentiment, shares of negative and positive ones, articles per topic group.

    One aggregate with partial counts; topics are conditional counts in it.
    """
    topics = [F.count_if(F.col("topic_name").isin(names)).cast("int").alias(column) for column, names in topic_groups.items()]
    count = F.count("article_id")
    share = lambda label: F.count_if(F.col("sentiment") == label) / count
    return articles.groupBy(F.col("publication_week").alias("week")).agg(
        count.cast("int").alias("article_count"),
        F.avg(signed_sentiment(F.col("sentiment"), F.col("sentiment_score"))).alias("average_sentiment"),
        share("negative").alias("negative_sentiment_ratio"), share("positive").alias("positive_sentiment_ratio"), *topics,
    )


def keyword_counts(keywords: DataFrame, groups: dict[str, str] = KEYWORD_GROUPS) -> DataFrame:
    """Per week: different articles that have a keyword with the substring, for every group.

    One row per week and article first, so the counts need no distinct.
    """
    hits = [F.max(F.lower("keyword").contains(part.lower()).cast("int")).alias(column) for column, part in groups.items()]
    per_article = keywords.groupBy(F.col("publication_week").alias("week"), "article_id").agg(*hits)
    return per_article.groupBy("week").agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("int").alias(c) for c in groups))


def entity_counts(entities: DataFrame, groups: dict[str, str] = ENTITY_GROUPS) -> DataFrame:
    """Per week: rows of each entity type."""
    return entities.groupBy(F.col("publication_week").alias("week")).agg(*(F.count_if(F.col("entity_type") == kind).cast("int").alias(c) for c, kind in groups.items()))


def weekly_panel(articles: DataFrame, keywords: DataFrame, entities: DataFrame) -> DataFrame:
    """All base columns of every week that has an article; weeks without keywords or entities have 0."""
    out = base_metrics(articles).join(keyword_counts(keywords), "week", "left").join(entity_counts(entities), "week", "left")
    return out.fillna(0, [*KEYWORD_GROUPS, *ENTITY_GROUPS])
