"""Registered queries for the operators of news processing and weekly signals, with SQL twins.

Orders stand for scored articles where weeks, sentiment and topics are needed:
week by order date, sentiment by status, topic by priority; their line items
stand for keywords and entities. Everything else runs on the news tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.config import FEATURES
from presswell.functions import dates, html, text
from presswell.functions.scoring import signed_sentiment
from presswell.operators import enrich, explore, metrics, store, topics
from presswell.operators.anomaly import anomaly_scores
from presswell.operators.current import newest_rows
from presswell.operators.dedup import assign_duplicates, exact_duplicates, greedy_marks, near_pairs, shared_values
from presswell.operators.events import label_weeks, lead_times
from presswell.operators.ml import leave_one_event_out, ml_dataset
from presswell.operators.trends import add_trends
from presswell.operators.validate import validate
from presswell.operators.weekly import base_metrics, child_dataset, entity_counts, keyword_counts
from presswell.plans.news_oracle import oracle
from presswell.plans.pipeline import cleaned
from presswell.session import materialize
from presswell.sources.tables import read_table
from presswell.streaming.ingest import weekly_events

TOPICS = {
    "fuel_topic_frequency": ["1-URGENT", "2-HIGH"], "iran_war_topic_frequency": ["3-MEDIUM"], "electricity_topic_frequency": ["4-NOT SPECIFIED"],
    "corruption_topic_frequency": ["5-LOW"], "healthcare_strike_topic_frequency": ["1-URGENT"], "consumer_prices_topic_frequency": ["2-HIGH", "5-LOW"],
    "disaster_recovery_topic_frequency": ["3-MEDIUM", "5-LOW"],
}
KEYWORDS = {"fuel_keyword_frequency": "widget", "shortage_keyword_frequency": "small", "protest_keyword_frequency": "hot", "crisis_keyword_frequency": "gear"}
ENTITIES = {"person_entity_frequency": "A", "organization_entity_frequency": "N", "location_entity_frequency": "R", "event_entity_frequency": "X", "money_entity_frequency": "Y"}
METRICS = ["article_count", "negative_sentiment_ratio", "fuel_topic_frequency", "iran_war_topic_frequency", "disaster_recovery_topic_frequency"]
EVENTS = "(1, 'Midweek', DATE '1996-03-13', DATE '1996-04-20'), (2, 'Open end', DATE '1997-06-02', NULL), (3, 'First of two', DATE '1998-09-07', DATE '1998-10-11'), (4, 'Overlap', DATE '1998-09-28', DATE '1998-11-01')"


# -- data ------------------------------------------------------------------
def _articles(spark: SparkSession, folder: str) -> DataFrame:
    o = read_table(spark, folder, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "negative").when(F.col("o_orderstatus") == "P", "positive").otherwise("neutral")
    return o.select(
        F.col("o_orderkey").alias("article_id"), dates.iso_week(F.col("o_orderdate").cast("date")).alias("publication_week"),
        label.alias("sentiment"), (F.col("o_totalprice") / 500000).alias("sentiment_score"), F.col("o_orderpriority").alias("topic_name"),
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("article_id"), "l_partkey", "l_returnflag")
    return items.join(_articles(spark, folder).select("article_id", "publication_week"), "article_id")


def _keyword_rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = read_table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("keyword"))
    return _lines(spark, folder).join(parts, "l_partkey").select("article_id", "publication_week", "keyword")


def _entity_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("article_id", "publication_week", F.col("l_returnflag").alias("entity_type"))


def _events(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {EVENTS} AS e(event_id, event_name, start_date, end_date)")


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    keywords = keyword_counts(_keyword_rows(spark, folder), KEYWORDS)
    entities = entity_counts(_entity_rows(spark, folder), ENTITIES)
    base = base_metrics(_articles(spark, folder), TOPICS)
    return materialize(base.join(keywords, "week", "left").join(entities, "week", "left").fillna(0, [*KEYWORDS, *ENTITIES]), "panel")


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return newest_rows(read_table(spark, folder, "scraped_news"), ["id"], "scraped_at")


def _processed(spark: SparkSession, folder: str) -> DataFrame:
    return newest_rows(read_table(spark, folder, "processed_news"), ["article_id"], "processing_timestamp")


def _completed(spark: SparkSession, folder: str) -> DataFrame:
    return _processed(spark, folder).where("processing_status = 'COMPLETED'")


def _weekly(spark: SparkSession, folder: str) -> DataFrame:
    return newest_rows(read_table(spark, folder, "temporal_features"), ["series", "week"], "computed_at")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _link_articles(spark: SparkSession, folder: str) -> DataFrame:
    links = _raw(spark, folder).select(F.col("id").alias("article_id"), "link")
    return _completed(spark, folder).select("article_id", "content_clean", "publication_date").join(links, "article_id", "left")


# -- queries ---------------------------------------------------------------
def weekly_base_metrics(spark, folder):
    return _rounded(base_metrics(_articles(spark, folder), TOPICS))


def weekly_trends(spark, folder):
    return _rounded(add_trends(_panel(spark, folder), groups=(TOPICS, KEYWORDS, ENTITIES)))


def weekly_anomaly(spark, folder):
    return _rounded(anomaly_scores(_panel(spark, folder), METRICS).select("week", "anomaly_score"))


def top_anomalous_weeks(spark, folder):
    return _rounded(anomaly_scores(_panel(spark, folder), METRICS).select("week", "article_count", "anomaly_score")).orderBy(F.desc_nulls_last("anomaly_score"), "week").limit(10)


def event_window_labels(spark, folder):
    return label_weeks(_panel(spark, folder), _events(spark))


def event_labels_series(spark, folder):
    labels = label_weeks(_weekly(spark, folder), read_table(spark, folder, "crisis_events"))
    return _weekly(spark, folder).select("series", "week").join(F.broadcast(labels), "week")  # one row per calendar week


def weekly_panel_full(spark, folder):
    return _rounded(_panel(spark, folder))


def full_signal_panel(spark, folder):
    panel = _panel(spark, folder)
    scored = anomaly_scores(add_trends(panel, groups=(TOPICS, KEYWORDS, ENTITIES)), METRICS)
    return _rounded(scored.join(label_weeks(panel, _events(spark)), "week", "left"))


def series_trends(spark, folder):
    rows = _weekly(spark, folder).select("series", "week", "article_count", "average_sentiment")
    rows = rows.withColumns({"t": F.lit(1), "k": F.lit(1), "e": F.lit(1)})
    return _rounded(add_trends(rows, ["series"], (["t"], ["k"], ["e"])).select("series", "week", "article_count_change", "sentiment_change", "ma_4week", "ma_8week"))


def series_anomaly(spark, folder):
    return _rounded(anomaly_scores(_weekly(spark, folder).select("series", "week", *METRICS), METRICS, series=["series"]).select("series", "week", "anomaly_score"), 4)


def keyword_distinct_articles(spark, folder):
    return keyword_counts(_keyword_rows(spark, folder), KEYWORDS)


def entity_row_counts(spark, folder):
    return entity_counts(_entity_rows(spark, folder), ENTITIES)


def validate_articles(spark, folder):
    return validate(_raw(spark, folder)).select("id", "reason", "is_valid")


def date_normalization(spark, folder):
    columns = dates.date_columns("date")
    return _raw(spark, folder).select("id", *(c.alias(n) if n != "published_at" else F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n) for n, c in columns.items()))


def week_to_monday(spark, folder):
    return _weekly(spark, folder).select("week").distinct().select("week", dates.week_monday(F.col("week")).alias("monday"))


def clean_articles(spark, folder):
    return _raw(spark, folder).select("id", text.clean_text(F.col("content")).alias("content_clean"), text.clean_text(F.col("title")).alias("title_clean"))


def strip_html(spark, folder):
    return _raw(spark, folder).select("id", text.strip_tags(F.col("content")).alias("content"))


def text_features(spark, folder):
    c = F.col("content_clean")
    return _completed(spark, folder).select("article_id", text.word_count(c).alias("words"), F.char_length(F.coalesce(c, F.lit(""))).alias("chars"), text.sentence_count(c).alias("sentences"))


def content_hashes(spark, folder):
    return _completed(spark, folder).select("article_id", text.content_hash(F.col("content_clean")).alias("content_hash"))


def exact_duplicates_link_then_hash(spark, folder):
    return exact_duplicates(_link_articles(spark, folder)).select("article_id", "duplicate_status", "duplicate_of")


def near_duplicate_pairs(spark, folder):
    t = _completed(spark, folder).select(F.col("article_id").alias("doc"), F.col("publication_date").alias("day"), F.col("content_clean").alias("text"))
    return near_pairs(t).select("a", "b", F.round("similarity", 6).alias("similarity"))


def near_duplicates_greedy(spark, folder):
    t = _completed(spark, folder).select(F.col("article_id").alias("doc"), F.col("publication_date").alias("day"), F.col("content_clean").alias("text"))
    return greedy_marks(near_pairs(t)).select(F.col("doc").alias("article_id"), "duplicate_of")


def duplicate_status(spark, folder):
    return assign_duplicates(_link_articles(spark, folder)).select("article_id", "duplicate_status", "duplicate_of")


def duplicate_preview(spark, folder):
    return shared_values(_raw(spark, folder).select("id", "link").where("link is not null"), "link").select("id", "link", "copies")


def existing_hashes(spark, folder):
    return read_table(spark, folder, "processed_news").where("content_hash is not null").groupBy("content_hash").agg(F.min("article_id").alias("first_article"))


def same_day_articles(spark, folder):
    links = _raw(spark, folder).select(F.col("id").alias("article_id"), "link")
    p = _processed(spark, folder).where("publication_date is not null and duplicate_status <> 'EXACT_DUPLICATE'").select("article_id", "publication_date")
    return p.join(links, "article_id")


def unprocessed_ids(spark, folder):
    return store.unprocessed(_raw(spark, folder), _processed(spark, folder)).select("id")


def needing_enrichment(spark, folder):
    return store.needing(_processed(spark, folder), read_table(spark, folder, "article_entities")).select("article_id")


def upsert_latest_wins(spark, folder):
    p = read_table(spark, folder, "processed_news").select("article_id", "processing_status", "processing_timestamp", "article_length_words")
    old = newest_rows(p.where("processing_status <> 'COMPLETED'"), ["article_id"], "processing_timestamp")
    done = store.upsert(old, p.where("processing_status = 'COMPLETED'").drop("article_length_words"), ["article_id"], "processing_timestamp")
    return done.select("article_id", "processing_status", F.col("processing_timestamp").cast("string").alias("at"), "article_length_words")


def new_links(spark, folder):
    batches = read_table(spark, folder, "news_batches").select(F.col("article_id").alias("id"), "link")
    return store.append_new_links(_raw(spark, folder), batches).select("id", "link")


def stage_log(spark, folder):
    rows = cleaned(_raw(spark, folder)).withColumn("duplicate_status", F.lit("UNIQUE"))
    return store.stage_log(rows).select("article_id", "step", "stage", "status", "message")


def sentiment_lexicon(spark, folder):
    return _rounded(enrich.score_sentiment(_completed(spark, folder)))


def signed_sentiment_daily(spark, folder):
    s = enrich.score_sentiment(_completed(spark, folder)).join(_completed(spark, folder).select("article_id", "publication_date"), "article_id")
    return _rounded(s.where("publication_date is not null").groupBy("publication_date").agg(F.count("*").alias("articles"), F.avg(signed_sentiment(F.col("sentiment"), F.col("sentiment_score"))).alias("average")))


def entities_pattern(spark, folder):
    return enrich.count_entities(enrich.pattern_mentions(_completed(spark, folder)))


def keywords_tfidf_topn(spark, folder):
    scores = enrich.keyword_scores(_completed(spark, folder), most=10)
    return enrich.top_keywords(scores).select("article_id", "keyword", F.round("score", 6).alias("score"), "rank")


def keywords_diverse(spark, folder):
    return enrich.diverse_keywords(enrich.keyword_scores(_completed(spark, folder), most=30))


def topic_assign_nearest_centroid(spark, folder):
    e = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), F.col("label").alias("topic_id"))
    centers = materialize(topics.mean_vectors(e), "centroids")
    return topics.nearest_topic(e, centers).select(F.col("doc").alias("vec_id"), "topic_id", F.round("similarity", 5).alias("similarity"))


def topic_fit(spark, folder):
    e = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return topics.fit_topics(e, nr_topics=12)


def topic_words_ctfidf(spark, folder):
    d = read_table(spark, folder, "documents").where("source is not null").select(F.col("source").alias("topic_id"), "text")
    return topics.topic_words(d)


def topic_rename(spark, folder):
    rows = read_table(spark, folder, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("topic_id"), F.col("o_orderpriority").alias("topic_name"))
    names = spark.createDataFrame([(1, "First of all"), (3, "In between")], "topic_id int, topic_name string")
    return topics.rename_topics(rows, names)


def binary_metrics(spark, folder):
    scored = _weekly(spark, folder).select("series", F.col("label_pre_crisis").alias("label"), (F.col("anomaly_score") / (F.col("anomaly_score") + 2)).alias("score"))
    return _rounded(metrics.binary_metrics(scored.where("score >= 0"), ["series"]))


def fold_averages(spark, folder):
    scored = _weekly(spark, folder).select(F.col("crisis_event").alias("fold"), F.col("label_pre_crisis").alias("label"), (F.col("anomaly_score") / (F.col("anomaly_score") + 2)).alias("score"))
    per = metrics.binary_metrics(scored.where("fold is not null and score >= 0"), ["fold"]).withColumn("model", F.lit("anomaly"))
    return _rounded(metrics.fold_averages(per, ["model"]))


def multiclass_metrics(spark, folder):
    guessed = enrich.score_sentiment(_completed(spark, folder)).join(_completed(spark, folder).select("article_id", "title_clean"), "article_id")
    truth, _ = enrich.lexicon_sentiment(F.col("title_clean"))
    return _rounded(metrics.class_metrics(guessed.select(truth.alias("truth"), F.col("sentiment").alias("guess")), ["negative", "neutral", "positive"]))


def confusion_matrix(spark, folder):
    truth, _ = enrich.lexicon_sentiment(F.col("title_clean"))
    guess, _ = enrich.lexicon_sentiment(F.col("content_clean"))
    return metrics.confusion(_completed(spark, folder).select(truth.alias("truth"), guess.alias("guess")), ["negative", "neutral", "positive"])


def loco_predictions(spark, folder):
    return leave_one_event_out(_weekly(spark, folder))


def lead_time(spark, folder):
    rows = _weekly(spark, folder).select("week", "crisis_event", F.lit("proxy").alias("model"), F.col("label_pre_crisis").alias("true_label"), (F.col("anomaly_score") / (F.col("anomaly_score") + 2)).alias("predicted_proba"))
    return lead_times(rows, read_table(spark, folder, "crisis_events"), 0.5, "proxy")


def lead_time_forest(spark, folder):
    return lead_times(loco_predictions(spark, folder), read_table(spark, folder, "crisis_events"))


def sentiment_pivot_ratio(spark, folder):
    return explore.pivot_ratio(_articles(spark, folder), "publication_week", "sentiment", ["negative", "neutral", "positive"])


def topic_share(spark, folder):
    return explore.shares(_articles(spark, folder), "topic_name")


def top_keywords_scored(spark, folder):
    k = _keyword_rows(spark, folder).join(_articles(spark, folder).select("article_id", "sentiment_score"), "article_id")
    return k.groupBy("keyword").agg(F.count("*").alias("n"), F.round(F.avg("sentiment_score"), 6).alias("average")).orderBy(F.desc("n"), "keyword").limit(25)


def date_pattern_counts(spark, folder):
    return explore.value_counts(_raw(spark, folder).select(dates.date_pattern(F.col("date")).alias("pattern")), "pattern")


def date_format_exceptions(spark, folder):
    return _raw(spark, folder).where(~F.coalesce(F.col("date").rlike(r"^[0-9]{2} [A-Za-z]{3} [0-9]{4}$"), F.lit(False))).select("id", "date")


def weekday_counts(spark, folder):
    d = _completed(spark, folder).where("publication_date is not null").select(F.date_format("publication_date", "EEEE").alias("weekday"), (F.weekday("publication_date") + 1).alias("place"))
    return explore.value_counts(d, "weekday", "place")


def weeks_with_fewest(spark, folder):
    d = _completed(spark, folder).where("publication_date is not null")
    return d.groupBy(F.trunc("publication_date", "week").alias("week_start")).agg(F.count("*").alias("n")).orderBy("n", "week_start").limit(10)


def null_empty_checks(spark, folder):
    return explore.null_and_empty(read_table(spark, folder, "scraped_news"), ["title", "content", "date", "link"])


def length_stats(spark, folder):
    return explore.length_summary(read_table(spark, folder, "documents"), "n_chars")


def length_histogram(spark, folder):
    return explore.histogram(read_table(spark, folder, "documents"), "n_chars")


def date_span(spark, folder):
    d = _completed(spark, folder)
    return d.agg(F.min("publication_date").alias("first"), F.max("publication_date").alias("last"), F.datediff(F.max("publication_date"), F.min("publication_date")).alias("days"), F.count_distinct("publication_date").alias("different"))


def examples_per_source(spark, folder):
    return explore.top_per_group(read_table(spark, folder, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 3)


def fold_label_counts(spark, folder):
    return explore.value_counts(_weekly(spark, folder), "crisis_event", "label_pre_crisis")


def sample_for_labelling(spark, folder):
    return explore.seeded_sample(_completed(spark, folder).select("article_id"), "article_id", 120, 42)


def strip_html_parsed(spark, folder):
    return html.strip_html(_raw(spark, folder), "content")


def raw_lookup(spark, folder):
    return store.by_ids(read_table(spark, folder, "scraped_news"), [7, 41, 3, -1]).select("id", "title", "date", "link").distinct()


def panel_scan(spark, folder):
    return _weekly(spark, folder).select("series", "week", "article_count", "crisis_event", "label_pre_crisis").orderBy("week", "series")


def events_scan(spark, folder):
    return read_table(spark, folder, "crisis_events").select("event_id", "event_name", "start_date", "end_date")


def topic_corpus(spark, folder):
    return _completed(spark, folder).select("article_id", topics.topic_text("title_clean", "content_clean").alias("text"))


def ml_weeks(spark, folder):
    return ml_dataset(_weekly(spark, folder)).select("series", "week", "label_pre_crisis", *FEATURES)


def entity_dataset(spark, folder):
    return child_dataset(_processed(spark, folder), read_table(spark, folder, "article_entities").distinct(), "entity_type")


def entity_weeks(spark, folder):
    return entity_counts(entity_dataset(spark, folder))


def sentiment_by_topic(spark, folder):
    a = _articles(spark, folder)
    return a.groupBy("topic_name").agg(*(F.count_if(F.col("sentiment") == v).alias(v) for v in ("negative", "neutral", "positive")), F.round(F.avg(signed_sentiment(F.col("sentiment"), F.col("sentiment_score"))), 6).alias("average"))


def weekly_event_windows(spark, folder):
    return weekly_events(read_table(spark, folder, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        weekly_base_metrics, weekly_trends, weekly_anomaly, top_anomalous_weeks, event_window_labels, event_labels_series, weekly_panel_full,
        full_signal_panel, series_trends, series_anomaly, keyword_distinct_articles, entity_row_counts, validate_articles, date_normalization,
        week_to_monday, clean_articles, strip_html, text_features, content_hashes, exact_duplicates_link_then_hash, near_duplicate_pairs,
        near_duplicates_greedy, duplicate_status, duplicate_preview, existing_hashes, same_day_articles, unprocessed_ids, needing_enrichment,
        upsert_latest_wins, new_links, stage_log, sentiment_lexicon, signed_sentiment_daily, entities_pattern, keywords_tfidf_topn, keywords_diverse,
        topic_assign_nearest_centroid, topic_fit, topic_words_ctfidf, topic_rename, binary_metrics, fold_averages, multiclass_metrics,
        confusion_matrix, loco_predictions, lead_time, lead_time_forest, sentiment_pivot_ratio, topic_share, top_keywords_scored, date_pattern_counts,
        date_format_exceptions, weekday_counts, weeks_with_fewest, null_empty_checks, length_stats, length_histogram, date_span,
        examples_per_source, fold_label_counts, sample_for_labelling, weekly_event_windows, strip_html_parsed, raw_lookup, panel_scan,
        events_scan, topic_corpus, ml_weeks, entity_dataset, entity_weeks, sentiment_by_topic,
    )
}

ORACLE = oracle(TOPICS, KEYWORDS, ENTITIES, METRICS, EVENTS)
