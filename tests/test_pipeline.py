import json
import time
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswell.operators import enrich, explore, topics
from presswell.operators.ml import leave_one_event_out, ml_dataset
from presswell.plans.pipeline import PROCESSED, enrich as enrich_all, full_panel, process_existing, process_new
from presswell.sources.tables import read_csv, read_name_map, read_sql_script
from presswell.streaming.ingest import process_stream, processed_table, read_articles, weekly_events

RAW = "id long, title string, content string, date string, link string"
BODY = "The northern port reopened on Monday after fuel tankers were delayed for weeks by a strike. "


def test_batch_then_single(spark):
    raw = spark.createDataFrame([
        (1, "Port", BODY + "One.", "01 Apr 2026", "a"), (2, "Port", BODY + "One.", "01 Apr 2026", "a"), (3, "Rice", "Rice prices rose again in the upland markets, traders told reporters there.", "01 Apr 2026", "c"),
        (4, "", "short", "01 Apr 2026", "d"),
    ], RAW)
    table, log = process_existing(raw, spark.createDataFrame([], PROCESSED))
    got = {r.article_id: r for r in table.collect()}
    assert got[1].duplicate_status == "UNIQUE" and got[2].duplicate_status == "EXACT_DUPLICATE" and got[2].duplicate_of == 1
    assert got[3].duplicate_status == "UNIQUE" and got[3].publication_week == "2026-W14" and got[3].processing_status == "COMPLETED"
    assert got[4].processing_status == "FAILED" and got[4].content_clean is None and got[4].duplicate_status is None
    assert {r.stage for r in log.collect()} == {"VALIDATION", "DATE_NORMALIZATION", "CLEANING", "DEDUPLICATION"}
    again, _ = process_existing(raw, table)
    assert again.count() == 4
    new = spark.createDataFrame([(5, "Port", BODY + "One.", "bad date", "e"), (6, "Other", "Entirely different words about a cricket match on a rainy day up north.", "01 Apr 2026", "f")], RAW)
    table, _ = process_new(new, table)
    got = {r.article_id: r for r in table.collect()}
    assert got[5].duplicate_status == "EXACT_DUPLICATE" and got[5].publication_date is None and got[6].duplicate_status == "UNIQUE"
    empty = (spark.createDataFrame([], "article_id long, sentiment string, sentiment_score double, sentiment_model string"), spark.createDataFrame([], "article_id long, keyword string, score double, rank int"), spark.createDataFrame([], "article_id long, entity string, entity_type string, confidence double"))
    s, k, e = enrich_all(table, *empty)
    events = spark.createDataFrame([(1, "E", date(2026, 4, 20), None)], "event_id int, event_name string, start_date date, end_date date")
    panel = full_panel(table, s, spark.createDataFrame([], "article_id long, topic_name string"), k, e, events).collect()
    assert [(r.week, r.article_count, r.label_pre_crisis) for r in panel] == [("2026-W14", 3, 1)]


def test_new_articles_meet_all_others(spark):
    row = lambda i, end, day, link: (i, "Port", BODY + end, day, link)
    table, _ = process_existing(spark.createDataFrame([row(50, "One.", "01 Apr 2026", "a"), row(60, "One.", "02 Apr 2026", "b")], RAW), spark.createDataFrame([], PROCESSED))
    batch = spark.createDataFrame([row(7, "One today.", "01 Apr 2026", "c"), (8, "Rice", BODY[::-1], "bad", "d"), (9, "Rice", BODY[::-1], "03 Apr 2026", "e"), row(50, "One.", "01 Apr 2026", "a")], RAW)
    got = {r.article_id: (r.duplicate_status, r.duplicate_of) for r in process_new(batch, table)[0].collect()}
    assert got[7] == ("NEAR_DUPLICATE", 50) or got[50] == ("NEAR_DUPLICATE", 7)
    assert got[8] == ("UNIQUE", None) and got[9] == ("EXACT_DUPLICATE", 8) and got[60] == ("EXACT_DUPLICATE", 50)
    got = {r.article_id: (r.duplicate_status, r.duplicate_of) for r in process_new(batch.where("id = 7"), table)[0].collect()}
    assert got[7] == ("NEAR_DUPLICATE", 50) and got[50] == ("UNIQUE", None)
    later = spark.createDataFrame([row(50, "One.", "01 Apr 2026", "a"), row(3, "One.", "bad", "x"), row(4, "One today.", "01 Apr 2026", "y"), (5, "Rice", BODY[::-1], "bad", "a"), (6, "Rice", BODY.upper()[::-1] + " More.", "bad", "z")], RAW)
    got = {r.article_id: (r.duplicate_status, r.duplicate_of) for r in process_existing(later, table)[0].collect()}
    assert got[3] == ("EXACT_DUPLICATE", 50) and got[4] == ("NEAR_DUPLICATE", 50) and got[5] == ("EXACT_DUPLICATE", 50) and got[6][0] == "UNIQUE"


def test_enrichment(spark):
    docs = spark.createDataFrame([(1, "Repairs welcomed by the Water Board in Vondlar, £40m spent. Repairs welcomed."), (2, "  "), (3, None), (4, "Strike delayed and cancelled, crisis in Vondlar")], "article_id long, content_clean string")
    s = {r.article_id: (r.sentiment, r.sentiment_score) for r in enrich.score_sentiment(docs).collect()}
    assert s == {1: ("positive", 1.0), 2: ("neutral", 0.0), 3: ("neutral", 0.0), 4: ("negative", 1.0)}
    e = {(r.article_id, r.entity, r.entity_type): r.confidence for r in enrich.count_entities(enrich.pattern_mentions(docs)).collect()}
    assert e[(1, "Water Board", "ORGANIZATION")] == 1.0 and e[(1, "Vondlar", "LOCATION")] == 1.0 and e[(1, "£40m", "MONEY")] == 1.0
    scores = enrich.keyword_scores(docs)
    top = enrich.top_keywords(scores, 3).collect()
    assert {r.article_id for r in top} == {1, 4} and [r["rank"] for r in top if r.article_id == 1] == [1, 2, 3]
    diverse = enrich.diverse_keywords(scores, 3).collect()
    assert [r["rank"] for r in diverse if r.article_id == 1] == [1, 2, 3]
    long = enrich.count_entities(spark.createDataFrame([(1, "x" * 300, "ORG"), (1, "d", "DATE")], "article_id long, entity string, label string")).collect()
    assert len(long) == 1 and len(long[0].entity) == 255


def test_topics(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(20)] + [(100 + i, [0.01 * i, 1.0]) for i in range(30)] + [(999, None)]
    found = topics.fit_topics(spark.createDataFrame(rows, "doc long, vector array<double>"), start=4, min_topic_size=5, nr_topics=2).collect()
    names = {r.doc: r.topic_id for r in found}
    assert len(names) == 50 and len({names[i] for i in range(20)}) == 1 and len({names[100 + i] for i in range(30)}) == 1 and names[100] == 0
    docs = spark.createDataFrame([(0, "fuel fuel queue"), (0, "fuel port"), (1, "rice rice market"), (1, None)], "topic_id int, text string")
    words = topics.topic_words(docs, 2)
    assert {r.topic_id: r.topic_name for r in topics.default_names(words).collect()} == {0: "fuel_port", 1: "rice_market"}
    table = spark.createDataFrame([(1, 0, "old"), (2, 1, "keep")], "article_id long, topic_id int, topic_name string")
    renamed = topics.rename_topics(table, spark.createDataFrame([(0, "new")], "topic_id int, topic_name string"))
    assert sorted(r.topic_name for r in renamed.collect()) == ["keep", "new"]


def test_leave_one_event_out(spark):
    from presswell.config import FEATURES

    rows = []
    for i in range(60):
        pre = 15 <= i < 20 or 40 <= i < 45
        label = None if i in (20, 21, 45, 46) else int(pre)
        rows.append((f"2025-W{i % 52 + 1:02d}", 1 if i < 32 else 2, label, *([float(10 * pre + i % 3)] * len(FEATURES))))
    panel = spark.createDataFrame(rows, "week string, crisis_event int, label_pre_crisis int, " + ", ".join(f"{f} double" for f in FEATURES))
    assert ml_dataset(panel).count() == 56
    got = leave_one_event_out(panel, trees=10, depth=4).collect()
    assert {(r.crisis_event, r.model) for r in got} == {(e, m) for e in (1, 2) for m in ("logistic_regression", "random_forest")}
    hits = [r.predicted_proba > 0.5 for r in got if r.true_label == 1 and r.model == "random_forest"]
    assert all(hits)
    with pytest.raises(ValueError):
        leave_one_event_out(panel.where("crisis_event = 1"))


def test_queries_fit_the_whole_forest(spark, monkeypatch):
    from presswell.plans import news_queries

    asked = []

    def fit(panel, *args, **options):
        asked.append((args, options))
        return spark.createDataFrame([("2025-W02", 1, "random_forest", 1, 0.9)], "week string, crisis_event int, model string, true_label int, predicted_proba double")

    events = spark.createDataFrame([(1, "E", date(2025, 1, 20))], "event_id int, event_name string, start_date date")
    monkeypatch.setattr(news_queries, "leave_one_event_out", fit)
    monkeypatch.setattr(news_queries, "_weekly", lambda *_: None)
    monkeypatch.setattr(news_queries, "read_table", lambda *_: events)
    assert news_queries.QUERIES["loco_predictions"](spark, "").count() == 1
    assert [tuple(r) for r in news_queries.QUERIES["lead_time_forest"](spark, "").collect()] == [(1, "E", "2025-W02", 14)]
    assert asked == [((), {})] * 2


def test_summaries(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "a", None), (3, "b", "x"), (4, None, "y")], "id long, k string, v string")
    assert {tuple(r) for r in explore.null_and_empty(df, ["k", "v"]).collect()} == {("k", 1, 0), ("v", 1, 1)}
    assert {r.k: r.percent for r in explore.shares(df, "k").collect()} == {"a": 50.0, "b": 25.0, None: 25.0}
    assert sum(r.n for r in explore.histogram(df, "id", 3).collect()) == 4
    one = explore.seeded_sample(df, "id", 2, 1).collect()
    assert one == explore.seeded_sample(df, "id", 2, 1).collect() and len(one) == 2
    assert explore.top_per_group(df, "k", [F.desc("id")], 1).count() == 3
    assert explore.histogram(df.limit(0), "id").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n"1","say ""hi"""\n"2",NULL\n')
    assert [(r.id, r.name) for r in read_csv(spark, str(tmp_path / "a.csv"), "id int, name string").collect()] == [(1, 'say "hi"'), (2, None)]
    (tmp_path / "n.json").write_text(json.dumps({"0": "x", "3": "y"}))
    assert {(r.topic_id, r.topic_name) for r in read_name_map(spark, str(tmp_path / "n.json")).collect()} == {(0, "x"), (3, "y")}
    assert read_sql_script("-- c\nSELECT 1;\n\nSELECT 2 -- keep\n;") == ["SELECT 1", "SELECT 2 -- keep"]


def test_stream(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    line = lambda i, c: json.dumps({"id": i, "title": "T", "content": c, "date": "01 Apr 2026", "link": f"l{i}"})
    (folder / "1.json").write_text(line(1, BODY + "One.") + "\n" + line(1, BODY + "One.") + "\n")
    process_stream(read_articles(spark, str(folder)), table, str(tmp_path / "cp")).awaitTermination(120)
    assert processed_table(spark, table).read().count() == 1
    time.sleep(0.1)
    (folder / "2.json").write_text(line(2, BODY + "One.") + "\n" + line(3, "x"))
    process_stream(read_articles(spark, str(folder)), table, str(tmp_path / "cp")).awaitTermination(120)
    got = {r.article_id: (r.processing_status, r.duplicate_status) for r in processed_table(spark, table).read().collect()}
    assert got == {1: ("COMPLETED", "UNIQUE"), 2: ("COMPLETED", "EXACT_DUPLICATE"), 3: ("FAILED", None)}
    from datetime import datetime

    events = spark.createDataFrame([(datetime(2024, 1, 7, 23), "a", 1.0), (datetime(2024, 1, 8), "a", 2.0)], "ts timestamp_ntz, event_type string, value double")
    assert {(r.week_start, r.n) for r in weekly_events(events).collect()} == {(date(2024, 1, 1), 1), (date(2024, 1, 8), 1)}


def test_models_are_plugged_in_by_batches(spark):
    from presswell.operators import models

    seen_at_once = 2

    def fake(result_of):
        def load():
            def predict(texts):
                assert 0 < len(texts) <= seen_at_once and all(t.strip() for t in texts)
                return [result_of(t) for t in texts]

            return predict

        return load

    docs = spark.createDataFrame([(1, "good news"), (2, None), (3, "  "), (4, "bad news"), (5, "good day")], "article_id long, content_clean string")
    scorer = models.BatchModel(fake(lambda t: ("LABEL_2" if "good" in t else "LABEL_0", 0.9)), models.SENTIMENT, seen_at_once)
    got = {r.article_id: (r.sentiment, r.sentiment_score, r.sentiment_model) for r in enrich.score_sentiment(docs, models.sentiment_backend(scorer), "fake").collect()}
    assert got == {1: ("positive", 0.9, "fake"), 2: ("neutral", 0.0, "fake"), 3: ("neutral", 0.0, "fake"), 4: ("negative", 0.9, "fake"), 5: ("positive", 0.9, "fake")}
    tagger = models.BatchModel(fake(lambda t: [("Vondlar", "GPE"), ("Vondlar", "GPE"), ("x", "DATE")] if "good" in t else []), models.ENTITIES, seen_at_once)
    assert {tuple(r) for r in enrich.count_entities(models.model_mentions(docs, tagger)).collect()} == {(1, "Vondlar", "LOCATION", 2.0), (5, "Vondlar", "LOCATION", 2.0)}
    extractor = models.BatchModel(fake(lambda t: [(w, float(len(w))) for w in t.split()]), models.KEYWORDS, seen_at_once)
    assert [(r.keyword, r["rank"]) for r in models.model_keywords(docs, extractor, 1).where("article_id = 5").collect()] == [("good", 1)]
    vectors = {r.article_id: r.vector for r in models.embedded(docs, models.hashed_vectors(16), "content_clean").collect()}
    assert vectors[2] is None and len(vectors[1]) == 16 and sum(x * x for x in vectors[1]) == pytest.approx(1) and vectors[1] != vectors[4]
    short = models.BatchModel(lambda: lambda texts: [], models.VECTOR)
    with pytest.raises(Exception, match="0 results for"):
        models.embedded(docs, short, "content_clean").collect()
    assert models.embedded(docs.limit(0), models.hashed_vectors(), "content_clean").count() == 0


def test_topic_stage_replaces_all_topics(spark, tmp_path):
    from presswell.operators.store import VersionedTable
    from presswell.plans.pipeline import topic_stage
    from presswell.schemas import TABLES

    kinds = ["fuel queue pump tanker petrol station", "rice market price onion seller bag", "clinic nurse strike ward doctor patient"]
    rows = [(i, "COMPLETED", "", kinds[i % 3] + f" extra{i % 4}") for i in range(60)] + [(90, "FAILED", None, None), (91, "COMPLETED", None, "  ")]
    done = spark.createDataFrame(rows, "article_id long, processing_status string, title_clean string, content_clean string")
    table = VersionedTable(spark, str(tmp_path / "t"), *TABLES["article_topics"])
    topic_stage(done.limit(5), table=table, start=2, min_topic_size=1)
    found, words = topic_stage(done, table=table, start=6, min_topic_size=5, nr_topics=3)
    names = {r.article_id: (r.topic_id, r.topic_name) for r in found.collect()}
    assert set(names) == set(range(60)) and {len({names[i] for i in range(k, 60, 3)}) for k in range(3)} == {1} and len(set(names.values())) == 3
    assert all(set(name.split("_")) & set(kinds[i % 3].split()) for i, (_, name) in names.items()) and words.count() > 3


def test_seed_labels_and_lookup(spark):
    from presswell.operators import metrics, store
    from presswell.plans.pipeline import seed_events

    none = spark.createDataFrame([], "event_id int, event_name string, crisis_type string, start_date date, end_date date, description string")
    seeded = seed_events(seed_events(none)).orderBy("event_id").collect()
    assert [(r.event_id, r.start_date) for r in seeded] == [(1, date(2026, 2, 28)), (2, date(2025, 11, 28))] and seeded[0].end_date is None
    rows = spark.createDataFrame([(1, " Positive "), (2, "NEGATIVE"), (3, "odd"), (4, None), (5, "odd ")], "id long, label string")
    kept, rejected = metrics.valid_labels(rows, "label", ["positive", "neutral", "negative"])
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "positive"), (2, "negative")]
    assert {(r.label, r.n) for r in rejected.collect()} == {("odd", 2), (None, 1)}
    assert sorted(r.id for r in store.by_ids(rows, [2, None, 5, 77]).collect()) == [2, 5] and store.by_ids(rows, []).count() == 0
    shown = rows.select(explore.categories(F.col("id"), {1: "green", 2: "gray"}, "red").alias("c")).collect()
    assert [r.c for r in shown] == ["green", "gray", "red", "red", "red"]


def test_full_evaluation(spark):
    from presswell.config import FEATURES
    from presswell.operators.ml import full_evaluation

    rows = []
    for i in range(60):
        pre = 15 <= i < 20 or 40 <= i < 45
        rows.append((f"2025-W{i % 52 + 1:02d}", 1 if i < 32 else 2, int(pre), *([float(10 * pre + i % 3)] * len(FEATURES))))
    panel = spark.createDataFrame(rows, "week string, crisis_event int, label_pre_crisis int, " + ", ".join(f"{f} double" for f in FEATURES))
    events = spark.createDataFrame([(1, "A", date(2025, 5, 19)), (2, "B", date(2025, 11, 10)), (3, "C", date(2026, 1, 1))], "event_id int, event_name string, start_date date")
    measures, leads = full_evaluation(panel, events, trees=10, depth=4)
    got = {(r.model, r.fold): r for r in measures.collect()}
    assert set(got) == {(m, f) for m in ("logistic_regression", "random_forest") for f in (1, 2, None)}
    forest = got["random_forest", 1]
    assert (forest.tp, forest.fn) == (5, 0) and forest.recall == 1.0 and got["random_forest", None].tp is None and got["random_forest", None].recall == 1.0
    assert {(r.event_id, r.first_detection_week) for r in leads.collect()} == {(1, "2025-W16"), (2, "2025-W41"), (3, None)}


def test_keyword_frequencies_are_sent_packed(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 60) % 500)) for i in range(700)] + [(700, None), (701, "")], "article_id long, content_clean string")
    packed, joined = enrich.keyword_scores(docs), enrich.keyword_scores(docs, most_packed=-1)
    assert "Broadcast" not in packed._jdf.queryExecution().executedPlan().toString()
    rows = lambda s: sorted((r.article_id, r.keyword, round(r.score, 9)) for r in s.collect())
    assert rows(packed) == rows(joined)
    for n in (1, 10):
        fewer = enrich.keyword_scores(docs, most=n)
        assert fewer.count() < packed.count()
        ranked = lambda s: sorted((r.article_id, r.keyword, r["rank"]) for r in enrich.top_keywords(s, n).collect())  # noqa: B023, E731
        assert ranked(fewer) == ranked(joined)


def test_named_topics_reach_the_panel(spark):
    from presswell.operators.weekly import base_metrics

    words = spark.createDataFrame([(0, "port", 1), (0, "fuel", 2), (0, "rice", 3), (1, "cup", 1), (1, "final", 2), (-1, "fuel", 1)], "topic_id int, word string, rank int")
    names = topics.default_names(words, {"Consumer Prices & Food (Rice/CAA)": "rice", "Fuel & Oil Prices (CPC)": "fuel"})
    assert {r.topic_id: r.topic_name for r in names.collect()} == {0: "Fuel & Oil Prices (CPC)", 1: "cup_final", -1: "outlier_uncategorized"}
    articles = names.selectExpr("topic_id as article_id", "'2026-W10' as publication_week", "'neutral' as sentiment", "0D as sentiment_score", "topic_name")
    assert base_metrics(articles).first().fuel_topic_frequency == 1
