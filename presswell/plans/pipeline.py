"""Operators put together: batch ingest, single new articles, the weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell import config
from presswell.functions.dates import date_columns
from presswell.functions.scoring import topic_name
from presswell.functions.text import clean_text, sentence_count, word_count
from presswell.operators.anomaly import anomaly_scores
from presswell.operators.dedup import assign_after, check_new
from presswell.operators.enrich import count_entities, keyword_scores, pattern_mentions, score_sentiment, top_keywords
from presswell.operators.events import label_weeks
from presswell.operators.models import BatchModel, embedded, hashed_vectors
from presswell.operators.store import VersionedTable, insert_new, needing, stage_log, unprocessed, upsert
from presswell.operators.topics import default_names, fit_topics, topic_text, topic_words
from presswell.operators.trends import add_trends
from presswell.operators.validate import validate
from presswell.operators.weekly import article_dataset, child_dataset, weekly_panel
from presswell.session import materialize

RAW_SCHEMA = "id long, title string, content string, date string, link string"
PROCESSED = (
    "article_id long, title_original string, title_clean string, content_original string, content_clean string, date_raw string, "
    "published_at timestamp_ntz, publication_date date, publication_year int, publication_month int, publication_week string, "
    "publication_day int, article_length_words int, article_length_chars int, sentence_count int, duplicate_status string, "
    "duplicate_of long, content_hash string, processing_status string, processing_timestamp timestamp_ntz, pipeline_version string"
)


def cleaned(raw: DataFrame) -> DataFrame:
    """Validated raw articles with all derived columns but those of duplicates; failed ones keep their originals only.

    One projection: nothing is shuffled.
    """
    valid = F.col("is_valid")
    rows = validate(raw).select(
        F.col("id").alias("article_id"), F.col("title").alias("title_original"), F.col("content").alias("content_original"),
        F.col("date").alias("date_raw"), "link", "reason", "is_valid",
    )
    rows = rows.withColumns({"title_clean": F.when(valid, clean_text(F.col("title_original"))), "content_clean": F.when(valid, clean_text(F.col("content_original")))})
    rows = rows.withColumns({
        "article_length_words": F.when(valid, word_count(F.col("content_clean"))),
        "article_length_chars": F.when(valid, F.char_length("content_clean")),
        "sentence_count": F.when(valid, sentence_count(F.col("content_clean"))),
    })
    return rows.withColumns({name: F.when(valid, column) for name, column in date_columns("date_raw").items()})


def _finish(rows: DataFrame, marks: DataFrame) -> DataFrame:
    full = rows.join(marks, "article_id", "left").withColumns({
        "processing_status": F.when(F.col("is_valid"), "COMPLETED").otherwise("FAILED"),
        "processing_timestamp": F.current_timestamp().cast("timestamp_ntz"), "pipeline_version": F.lit(config.PIPELINE_VERSION),
    })
    return full


def _columns(spark: SparkSession) -> list:
    schema = spark.createDataFrame([], PROCESSED).schema
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]


def _known(processed: DataFrame) -> DataFrame:
    return processed.where("processing_status = 'COMPLETED'").select("article_id", "content_clean", "content_hash", "publication_date", "duplicate_status", "duplicate_of")


def process_existing(raw: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(processed table after the run, log rows) of all articles not processed yet or failed.

    Duplicates are judged over the whole run, not batch by batch, and against
    what is processed already, whose links are those of ``raw``.
    """
    rows = materialize(cleaned(unprocessed(raw, processed)), "cleaned")
    links = raw.select(F.col("id").alias("article_id"), "link").dropDuplicates(["article_id"])
    marks = assign_after(rows.where("is_valid").select("article_id", "content_clean", "link", "publication_date"), _known(processed).join(links, "article_id", "left"))
    full = materialize(_finish(rows, marks), "processed")
    return upsert(processed, full.select(*_columns(raw.sparkSession)), ["article_id"]), stage_log(full)


def new_rows(new: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows for the processed table, log rows) of new articles, each judged against everything processed before."""
    rows = materialize(cleaned(new), "cleaned")
    marks = check_new(rows.where("is_valid").select("article_id", "content_clean", "publication_date"), _known(processed))
    full = materialize(_finish(rows, marks), "processed")
    return full.select(*_columns(new.sparkSession)), stage_log(full)


def process_new(new: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(processed table after the run, log rows) of new articles."""
    rows, log = new_rows(new, processed)
    return upsert(processed, rows, ["article_id"]), log


def enrich(processed: DataFrame, sentiment: DataFrame, keywords: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of enrichments with rows for the COMPLETED articles that lack them."""
    s = upsert(sentiment, score_sentiment(needing(processed, sentiment)), ["article_id"])
    k = top_keywords(keyword_scores(needing(processed, keywords), most=10)).select("article_id", "keyword", "score", "rank")
    e = count_entities(pattern_mentions(needing(processed, entities)))
    return s, upsert(keywords, k, ["article_id", "rank"]), upsert(entities, e, ["article_id", "entity", "entity_type"])


def topic_stage(processed: DataFrame, model: BatchModel | None = None, table: VersionedTable | None = None, known: dict[str, str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(article_id, topic_id, topic_name, topic_probability) of all COMPLETED articles, and (topic_id, word, score, rank).

    The whole corpus is embedded and fitted anew, so with ``table`` all its
    rows are replaced at once: topics of different fits never mix. ``model``
    embeds texts (``hashed_vectors`` by default); ``known`` is that of
    ``default_names``, ``options`` are those of ``fit_topics``. Articles without words have no topic.
    """
    corpus = processed.where("processing_status = 'COMPLETED'").select(F.col("article_id").alias("doc"), topic_text("title_clean", "content_clean").alias("text"))
    vectors = materialize(embedded(corpus, model or hashed_vectors()), "vectors")
    assigned = materialize(fit_topics(vectors.select("doc", "vector"), **options), "topics")
    words = materialize(topic_words(vectors.select("doc", "text").join(assigned, "doc").select("topic_id", "text")), "words")
    rows = assigned.join(F.broadcast(default_names(words, known)), "topic_id", "left")  # a row per topic
    rows = rows.select(F.col("doc").alias("article_id"), "topic_id", F.coalesce("topic_name", topic_name(F.col("topic_id"), F.array().cast("array<string>"))).alias("topic_name"), "topic_probability")
    if table is not None:
        table.replace(rows)
        rows = table.read()
    return rows, words


def write_panel(table: VersionedTable, panel: DataFrame) -> DataFrame:
    """Upsert the weekly panel by week in one step and return the table; running it again changes nothing."""
    table.upsert(panel)
    return table.read()


def seed_events(existing: DataFrame) -> DataFrame:
    """The events table with the known events it lacks, by name; their ids follow the greatest there is."""
    spark = existing.sparkSession
    start = existing.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    rows = [(start + k + 1, *e) for k, e in enumerate(config.EVENT_SEED)]
    seed = spark.createDataFrame(rows, "event_id int, event_name string, crisis_type string, start_date string, end_date string")
    seed = seed.withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    return insert_new(existing, seed, ["event_name"])


def full_panel(processed: DataFrame, sentiment: DataFrame, topics: DataFrame, keywords: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """The weekly panel with trends, event labels and anomaly scores, in one plan, so no rerun of one part erases another."""
    base = weekly_panel(article_dataset(processed, sentiment, topics), child_dataset(processed, keywords, "keyword"), child_dataset(processed, entities, "entity_type"))
    panel = materialize(base, "panel")  # a row per week
    return anomaly_scores(add_trends(panel)).join(label_weeks(panel, events), "week", "left")
