"""Registered queries that put the operators together on the news tables, with SQL twins where SQL can follow them.

Topics of the panel with a twin come from words, given below; those of
``topic_stage`` and ``news_signals`` are fitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell import config
from presswell.operators import enrich, explore, metrics, store, weekly
from presswell.operators.current import newest_rows
from presswell.operators.dedup import check_new
from presswell.operators.ml import full_evaluation as evaluate
from presswell.plans import news_oracle as sql
from presswell.plans import pipeline
from presswell.plans.news_queries import ORACLE as NEWS_ORACLE
from presswell.plans.news_queries import full_signal_panel
from presswell.schemas import TABLES
from presswell.session import materialize, scratch_path
from presswell.sources.tables import read_table

#: Topic names of the panel and a word of the texts that stands for each here.
WORDS = {
    "Fuel & Oil Prices (CPC)": "fuel", "Electricity Tariffs & CEB": "power", "Arrests, Bribery & Corruption (CIABOC)": "audit", "Healthcare Worker Strikes (GMOA)": "clinic",
    "Consumer Prices & Food (Rice/CAA)": "rice", "General Sri Lanka News (Cyclone Ditwah relief, Rupee, Tourism)": "flood",
}


# -- data ------------------------------------------------------------------
def _processed(spark: SparkSession, folder: str) -> DataFrame:
    return newest_rows(read_table(spark, folder, "processed_news"), ["article_id"], "processing_timestamp")


def _completed(spark: SparkSession, folder: str) -> DataFrame:
    return _processed(spark, folder).where("processing_status = 'COMPLETED'")


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return newest_rows(read_table(spark, folder, "scraped_news"), ["id"], "scraped_at")


def _word_topics(articles: DataFrame) -> DataFrame:
    text = F.lower(F.coalesce("content_clean", F.lit("")))
    named = F.array(*(F.when(F.contains(text, F.lit(word)), F.lit(name)) for name, word in WORDS.items()))
    return articles.select("article_id", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("topic_name"))


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    done = _completed(spark, folder)
    return weekly.article_dataset(_processed(spark, folder), enrich.score_sentiment(done), _word_topics(done))


def _keywords(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.top_keywords(enrich.keyword_scores(_completed(spark, folder), most=10))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "article_entities").distinct()


def _earlier(spark: SparkSession, folder: str) -> DataFrame:
    """Ids an earlier enrichment run had: articles completed in their oldest processed row."""
    rows = read_table(spark, folder, "processed_news").where("article_id is not null")
    oldest = rows.groupBy("article_id").agg(F.min(F.struct("processing_timestamp", "processing_status")).alias("first"))
    return oldest.where("first.processing_status = 'COMPLETED'").select("article_id")


def _panel_table(spark: SparkSession) -> store.VersionedTable:
    return store.VersionedTable(spark, scratch_path(spark, "panel-table"), *TABLES["temporal_features"])


# -- queries ---------------------------------------------------------------
def news_article_dataset(spark, folder):
    """Articles with sentiment and topics; one with several topics has several rows."""
    return _articles(spark, folder)


def news_keyword_dataset(spark, folder):
    return weekly.child_dataset(_processed(spark, folder), _keywords(spark, folder), "keyword")


def news_panel(spark, folder):
    """The weekly panel of processed articles, their keywords and named entities."""
    p = _processed(spark, folder)
    panel = weekly.weekly_panel(_articles(spark, folder), weekly.child_dataset(p, _keywords(spark, folder), "keyword"), weekly.child_dataset(p, _entities(spark, folder), "entity_type"))
    return panel.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in panel.dtypes))


def needing_sentiment(spark, folder):
    return store.needing(_processed(spark, folder), _earlier(spark, folder)).select("article_id")


def needing_keywords(spark, folder):
    """Articles without a keyword row: those an earlier run lacked, and those it found no keyword for."""
    earlier = _completed(spark, folder).join(_earlier(spark, folder), "article_id", "left_semi")
    found = earlier.select("article_id", F.explode(enrich.ngrams(F.col("content_clean"))).alias("keyword"))
    return store.needing(_processed(spark, folder), found).select("article_id")


def labelled_sample(spark, folder):
    """The sample for labelling beside what the scorer says."""
    sample = explore.seeded_sample(_completed(spark, folder).select("article_id"), "article_id", 120, 42)
    return sample.join(enrich.score_sentiment(_completed(spark, folder)).select("article_id", "sentiment", F.round("sentiment_score", 6).alias("sentiment_score")), "article_id", "left")


def label_rejects(spark, folder):
    """Entity types that are no person, organization or location, and how often each occurs."""
    return metrics.valid_labels(read_table(spark, folder, "article_entities"), "entity_type", ["person", "organization", "location"])[1]


def label_categories(spark, folder):
    rows = newest_rows(read_table(spark, folder, "temporal_features"), ["series", "week"], "computed_at")
    return explore.value_counts(rows.select("series", explore.categories(F.col("label_pre_crisis"), config.LABEL_COLOURS, "red").alias("colour")), "series", "colour")


def stored_panel(spark, folder):
    """The signal panel after it was written twice into its table, in two parts and whole."""
    table = _panel_table(spark)
    panel = materialize(full_signal_panel(spark, folder), "signals")
    pipeline.write_panel(table, panel.where("week < '1996'"))
    pipeline.write_panel(table, panel)
    return pipeline.write_panel(table, panel).select(*panel.columns)


def batch_check(spark, folder):
    """Incoming articles judged against all processed ones, none of which is judged again."""
    new = newest_rows(read_table(spark, folder, "news_batches"), ["article_id"], "received_at").select("article_id", "content_clean", "publication_date")
    known = _completed(spark, folder).select("article_id", "content_clean", "content_hash", "publication_date", "duplicate_status", "duplicate_of")
    return check_new(new, known).select("article_id", "duplicate_status", "duplicate_of")


def process_existing_news(spark, folder):
    """The processed table after a run over all raw articles that are not processed or failed."""
    raw = _raw(spark, folder).select("id", "title", "content", "date", "link")
    rows, _ = pipeline.process_existing(raw, _processed(spark, folder))
    return rows.select("article_id", "processing_status", "duplicate_status", "duplicate_of", "publication_date")


def process_existing_status(spark, folder):
    """The same without what is said of duplicates."""
    return process_existing_news(spark, folder).drop("duplicate_status", "duplicate_of")


def process_new_news(spark, folder):
    """What the same articles become when they come in as new ones."""
    raw = _raw(spark, folder).select("id", "title", "content", "date", "link")
    rows, _ = pipeline.new_rows(store.unprocessed(raw, _processed(spark, folder)), _processed(spark, folder))
    return rows.select("article_id", "processing_status", "duplicate_status", "duplicate_of", "publication_date")


def seeded_events(spark, folder):
    once = pipeline.seed_events(read_table(spark, folder, "crisis_events"))
    return pipeline.seed_events(once).select("event_name", "crisis_type", "start_date", "end_date")


def topic_stage(spark, folder):
    """Embed, fit, name and store the topics of all completed articles, twice: the second fit replaces the first."""
    table = store.VersionedTable(spark, scratch_path(spark, "topic-table"), *TABLES["article_topics"])
    done = materialize(_completed(spark, folder), "completed")
    pipeline.topic_stage(done, table=table, nr_topics=12)
    return pipeline.topic_stage(done, table=table, nr_topics=24)[0]


def news_signals(spark, folder):
    """Raw enrichment to signals in one run: sentiment, keywords, entities, fitted topics, panel, trends, labels, anomaly scores."""
    done = materialize(_completed(spark, folder), "completed")
    topics, _ = pipeline.topic_stage(done, known=WORDS, nr_topics=24)  # the panel counts topics by these names
    sentiment = enrich.score_sentiment(done)
    return pipeline.full_panel(_processed(spark, folder), sentiment, topics, _keywords(spark, folder), _entities(spark, folder), read_table(spark, folder, "crisis_events"))


def full_evaluation(spark, folder):
    """Measures of both models per fold and over all folds, from one fit."""
    rows = newest_rows(read_table(spark, folder, "temporal_features"), ["series", "week"], "computed_at")
    return evaluate(rows, read_table(spark, folder, "crisis_events"))[0]


QUERIES = {
    f.__name__: f
    for f in (
        news_article_dataset, news_keyword_dataset, news_panel, needing_sentiment, needing_keywords, labelled_sample, label_rejects, label_categories,
        stored_panel, batch_check, process_existing_news, process_existing_status, process_new_news, seeded_events, topic_stage, news_signals, full_evaluation,
    )
}


# -- twins -----------------------------------------------------------------
_LABEL, _SCORE = sql._lexicon("content_clean")
_POPULATION = "p.processing_status = 'COMPLETED' AND p.duplicate_status <> 'EXACT_DUPLICATE' AND p.publication_week IS NOT NULL"
_TOPICS = " UNION ALL ".join(f"SELECT article_id, '{name}' AS topic_name FROM {sql.COMPLETED} WHERE contains(lower(coalesce(content_clean, '')), '{word}')" for name, word in WORDS.items())
_DATASET = f"""s AS (SELECT article_id, {_LABEL} AS sentiment, {_SCORE} AS sentiment_score FROM {sql.COMPLETED}), t AS ({_TOPICS}),
articles AS (SELECT p.article_id, p.publication_week, s.sentiment, s.sentiment_score, t.topic_name FROM {sql.PROCESSED} p LEFT JOIN s USING (article_id) LEFT JOIN t USING (article_id) WHERE {_POPULATION})"""
_KEYWORD_ROWS = f"keywords AS (SELECT k.article_id, p.publication_week, k.keyword FROM ({NEWS_ORACLE['keywords_tfidf_topn']}) k JOIN {sql.PROCESSED} p USING (article_id) WHERE {_POPULATION})"
_ENTITY_ROWS = f"entities AS (SELECT e.article_id, p.publication_week, e.entity_type FROM (SELECT DISTINCT * FROM article_entities) e JOIN {sql.PROCESSED} p ON p.article_id = e.article_id WHERE {_POPULATION})"
_EARLIER = "(SELECT article_id FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY processing_timestamp NULLS FIRST, processing_status NULLS FIRST) AS r FROM processed_news WHERE article_id IS NOT NULL) WHERE r = 1 AND processing_status = 'COMPLETED')"
_T = ", ".join(f"CAST(count(*) FILTER (topic_name IN {sql._in(n)}) AS INTEGER) AS {c}" for c, n in config.TOPIC_GROUPS.items())
_K = ", ".join(f"CAST(count(DISTINCT CASE WHEN contains(lower(keyword), '{w}') THEN article_id END) AS INTEGER) AS {c}" for c, w in config.KEYWORD_GROUPS.items())
_E = ", ".join(f"CAST(count(*) FILTER (entity_type = '{t}') AS INTEGER) AS {c}" for c, t in config.ENTITY_GROUPS.items())
_ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*config.KEYWORD_GROUPS, *config.ENTITY_GROUPS])
_EVENT_ROWS = ", ".join(f"('{n}', '{k}', DATE '{a}', " + (f"DATE '{z}'" if z else "NULL") + ")" for n, k, a, z in config.EVENT_SEED)

_STATUS = "CASE WHEN ex.m IS NOT NULL THEN 'EXACT_DUPLICATE' WHEN near.m IS NOT NULL THEN 'NEAR_DUPLICATE' ELSE 'UNIQUE' END"
#: Of new articles n (article_id, content_clean, publication_date, h): the least exact match ex.m and near match near.m among known and new ones.
_CHECKED = f"""known AS (SELECT * FROM {sql.COMPLETED} WHERE article_id NOT IN (SELECT article_id FROM n)),
others AS (SELECT content_hash AS h, article_id AS id, duplicate_of AS of, true AS old FROM known UNION ALL SELECT h, article_id, NULL, false FROM n),
ex AS (SELECT n.article_id, min(o.id) AS m FROM n JOIN others o ON o.h = n.h AND CASE WHEN old THEN coalesce(o.of <> n.article_id, true) ELSE o.id < n.article_id END GROUP BY 1),
around AS (SELECT article_id, publication_date, content_clean, duplicate_of FROM known WHERE coalesce(duplicate_status, 'EXACT_DUPLICATE') <> 'EXACT_DUPLICATE' AND publication_date IN (SELECT publication_date FROM n WHERE publication_date IS NOT NULL)),
src AS (SELECT article_id AS doc, publication_date AS day, content_clean AS text FROM around UNION ALL SELECT article_id, publication_date, content_clean FROM n WHERE article_id NOT IN (SELECT article_id FROM ex)),
{sql._pairs('src')}, sides AS (SELECT a AS x, b AS o FROM pairs UNION ALL SELECT b, a FROM pairs),
near AS (SELECT x, min(o) AS m FROM sides LEFT JOIN around ON around.article_id = o WHERE x IN (SELECT article_id FROM n) AND CASE WHEN around.article_id IS NULL THEN o < x ELSE coalesce(duplicate_of <> x, true) END GROUP BY x)"""
#: Raw articles that are not processed or failed, with what validation and dates make of them.
_TODO = f"""todo AS (SELECT id AS article_id, content, CASE WHEN {sql._REASON} = '' THEN 'COMPLETED' ELSE 'FAILED' END AS processing_status, CASE WHEN {sql._REASON} = '' THEN {sql._date('date')} END AS publication_date
  FROM {sql.RAW} WHERE id NOT IN (SELECT article_id FROM {sql.PROCESSED} WHERE processing_status IS DISTINCT FROM 'FAILED'))"""

ORACLE = {
    "news_article_dataset": f"WITH {_DATASET} SELECT * FROM articles",
    "news_keyword_dataset": f"WITH {_KEYWORD_ROWS} SELECT * FROM keywords",
    "news_panel": f"""WITH {_DATASET}, {_KEYWORD_ROWS}, {_ENTITY_ROWS},
base AS (SELECT publication_week AS week, CAST(count(*) AS INTEGER) AS article_count, round(avg(CASE sentiment WHEN 'positive' THEN sentiment_score WHEN 'negative' THEN -sentiment_score ELSE 0 END), 6) AS average_sentiment,
  round(count(*) FILTER (sentiment = 'negative') / count(*), 6) AS negative_sentiment_ratio, round(count(*) FILTER (sentiment = 'positive') / count(*), 6) AS positive_sentiment_ratio, {_T} FROM articles GROUP BY 1),
kw AS (SELECT publication_week AS week, {_K} FROM keywords GROUP BY 1), en AS (SELECT publication_week AS week, {_E} FROM entities GROUP BY 1)
SELECT base.*, {_ZERO} FROM base LEFT JOIN kw USING (week) LEFT JOIN en USING (week)""",
    "needing_sentiment": f"SELECT article_id FROM {sql.COMPLETED} WHERE article_id NOT IN {_EARLIER}",
    "needing_keywords": f"""WITH k AS (SELECT article_id FROM {sql.COMPLETED} WHERE article_id IN {_EARLIER} AND len(list_filter({sql._tokens('content_clean')}, lambda x: x NOT IN {sql._in(list(config.STOPWORDS))})) > 0)
SELECT article_id FROM {sql.COMPLETED} WHERE article_id NOT IN (SELECT article_id FROM k)""",
    "labelled_sample": f"WITH c AS (SELECT article_id FROM {sql.COMPLETED} ORDER BY sha256(article_id || ':42') LIMIT 120) SELECT article_id, {_LABEL} AS sentiment, round({_SCORE}, 6) AS sentiment_score FROM c LEFT JOIN {sql.COMPLETED} d USING (article_id)",
    "label_rejects": f"SELECT lower(trim(entity_type)) AS entity_type, count(*) AS n FROM article_entities WHERE entity_type IS NULL OR lower(trim(entity_type)) NOT IN ('person', 'organization', 'location') GROUP BY 1",
    "label_categories": f"SELECT series, CASE label_pre_crisis WHEN 1 THEN 'green' WHEN 0 THEN 'gray' ELSE 'red' END AS colour, count(*) AS n FROM {sql.WEEKLY} GROUP BY ALL",
    "stored_panel": NEWS_ORACLE["full_signal_panel"],
    "batch_check": f"""WITH n AS (SELECT article_id, content_clean, publication_date, {sql._HASH} AS h FROM {sql._newest('news_batches', 'article_id', 'received_at')}), {_CHECKED}
SELECT n.article_id, {_STATUS} AS duplicate_status, coalesce(ex.m, near.m) AS duplicate_of FROM n LEFT JOIN ex USING (article_id) LEFT JOIN near ON near.x = n.article_id""",
    "process_existing_status": f"""WITH {_TODO}
SELECT article_id, processing_status, publication_date FROM todo
UNION ALL SELECT article_id, processing_status, publication_date FROM {sql.PROCESSED} WHERE article_id NOT IN (SELECT article_id FROM todo)""",
    "process_new_news": f"""WITH {_TODO},
n AS (SELECT article_id, content_clean, publication_date, {sql._HASH} AS h FROM (SELECT article_id, {sql._clean('content')} AS content_clean, publication_date FROM todo WHERE processing_status = 'COMPLETED')), {_CHECKED}
SELECT todo.article_id, todo.processing_status, CASE WHEN todo.processing_status = 'COMPLETED' THEN {_STATUS} END AS duplicate_status, coalesce(ex.m, near.m) AS duplicate_of, todo.publication_date
FROM todo LEFT JOIN ex USING (article_id) LEFT JOIN near ON near.x = todo.article_id""",
    "seeded_events": f"SELECT event_name, crisis_type, start_date, end_date FROM crisis_events UNION ALL SELECT * FROM (VALUES {_EVENT_ROWS}) AS v(event_name, crisis_type, start_date, end_date) WHERE event_name NOT IN (SELECT event_name FROM crisis_events)",
}
