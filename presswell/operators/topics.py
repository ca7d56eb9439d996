"""Topics over document vectors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswell.functions.scoring import cosine, topic_name
from presswell.functions.text import strip, tokens

MOST_TOPICS = 10_000


def topic_text(title: str, content: str):
    """Title and content as one text; NULL is ''."""
    return strip(F.concat_ws(" ", strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(content, F.lit("")))))


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """(topic_id, vector): means of ``vectors`` (topic_id, vector), by place, with partial sums."""
    places = vectors.where("vector is not null").select("topic_id", F.posexplode("vector").alias("at", "x"))
    means = places.groupBy("topic_id", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))  # one vector
    return ordered.select("topic_id", F.transform("v", lambda e: e["x"]).alias("vector"))


def nearest_topic(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(doc, topic_id, similarity) by cosine; ties go to the least topic. The number of topics is checked."""
    if centroids.limit(MOST_TOPICS + 1).count() > MOST_TOPICS:
        raise ValueError("too many topics to compare every vector with")
    c = F.broadcast(centroids.select("topic_id", F.col("vector").alias("centroid")))
    met = vectors.where("vector is not null").select("doc", "vector").join(c).withColumn("similarity", cosine(F.col("vector"), F.col("centroid")))
    best = F.max_by(F.struct("topic_id", "similarity"), F.struct(F.round("similarity", 9), -F.col("topic_id"))).alias("b")
    return met.groupBy("doc").agg(best).select("doc", "b.topic_id", "b.similarity")


def fit_topics(vectors: DataFrame, start: int = 40, min_topic_size: int = 15, nr_topics: int | None = None, reduce_outliers: bool = True, seed: int = 42) -> DataFrame:
    """(doc, topic_id, topic_probability): clusters of ``vectors`` (doc, vector).

    Clusters smaller than ``min_topic_size`` become -1; the nearest centroids
    merge until ``nr_topics`` are left; -1 goes to the nearest topic if
    ``reduce_outliers``. Topics are numbered by size. Only centroids and sizes
    reach the driver.
    """
    rows = vectors.where("vector is not null").withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    model = KMeans(k=start, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    labelled = model.transform(rows).select("doc", "vector", "cluster")
    sizes = {r["cluster"]: r["count"] for r in labelled.groupBy("cluster").count().collect()}
    centers = {i: c / (np.linalg.norm(c) or 1.0) for i, c in enumerate(model.clusterCenters()) if sizes.get(i, 0) >= min_topic_size}
    group = {i: i for i in centers}
    weight = {i: sizes[i] for i in centers}
    while nr_topics and len(centers) > max(1, nr_topics):
        ids = sorted(centers)
        matrix = np.array([centers[i] for i in ids])
        close = matrix @ matrix.T - 2 * np.eye(len(ids))
        a, b = (ids[k] for k in sorted(divmod(int(close.argmax()), len(ids))))
        merged = centers[a] * weight[a] + centers[b] * weight[b]
        centers[a], weight[a] = merged / (np.linalg.norm(merged) or 1.0), weight[a] + weight[b]
        del centers[b]
        group = {i: a if g == b else g for i, g in group.items()}
    number = {g: k for k, g in enumerate(sorted(centers, key=lambda g: (-weight[g], g)))}
    table = [(i, number[group[i]] if i in group else -1) for i in range(start)]
    spark = vectors.sparkSession
    out = labelled.join(F.broadcast(spark.createDataFrame(table, "cluster int, topic_id int")), "cluster")
    if reduce_outliers and number:
        spots = spark.createDataFrame([(number[g], [float(x) for x in centers[g]]) for g in number], "topic_id int, vector array<double>")
        lost = nearest_topic(out.where("topic_id = -1").select("doc", "vector"), spots).select("doc", "topic_id")
        out = out.where("topic_id <> -1").select("doc", "topic_id").unionByName(lost)
    return out.select("doc", "topic_id", F.lit(1.0).alias("topic_probability"))


def topic_words(docs: DataFrame, n: int = 10) -> DataFrame:
    """(topic_id, word, score, rank): class-based term weights ``tf * ln(1 + A / f)`` of ``docs`` (topic_id, text).

    tf is the word's share of the topic's words, A the mean number of words
    per topic, f the word's count over all topics; ties by word.
    """
    counts = docs.select("topic_id", F.explode(tokens(F.col("text"))).alias("word")).groupBy("topic_id", "word").agg(F.count("*").alias("tf"))
    topics = counts.groupBy("topic_id").agg(F.sum("tf").alias("size"))
    mean = topics.agg(F.avg("size").alias("a"))  # one row
    words = counts.groupBy("word").agg(F.sum("tf").alias("f"))
    scored = counts.join(words, "word").join(topics, "topic_id").join(F.broadcast(mean))
    score = F.round(F.col("tf") / F.col("size") * F.log(1 + F.col("a") / F.col("f")), 9)
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), "word"))
    return scored.select("topic_id", "word", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= n)


def default_names(words: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """(topic_id, topic_name) from the words of each topic.

    ``known`` has names and a word that stands for each: a topic takes the
    name whose word comes first among its words, else its own first words.
    """
    listed = words.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("w"))
    name = topic_name(F.col("topic_id"), F.col("w"))
    if known:
        places = F.array(*(F.struct(F.array_position("w", F.lit(word)).alias("at"), F.lit(n).alias("name")) for n, word in known.items()))
        first = F.array_min(F.filter(places, lambda x: x["at"] > 0))["name"]
        name = F.when(F.col("topic_id") == -1, name).otherwise(F.coalesce(first, name))
    return listed.select("topic_id", name.alias("topic_name"))


def rename_topics(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with topic_name from ``names`` (topic_id, topic_name) where there is one."""
    new = names.select("topic_id", F.col("topic_name").alias("__name"))
    return rows.join(new, "topic_id", "left").withColumn("topic_name", F.coalesce("__name", "topic_name")).drop("__name").select(*rows.columns)
