import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswell.operators.anomaly import anomaly_scores
from presswell.operators.events import label_weeks, lead_times
from presswell.operators.metrics import binary_metrics, class_metrics, confusion, fold_averages
from presswell.operators.trends import add_trends
from presswell.operators.weekly import article_dataset, base_metrics, child_dataset, weekly_panel

PROC = "article_id long, publication_week string, processing_status string, duplicate_status string"


def week(monday):
    y, w, _ = monday.isocalendar()
    return f"{y}-W{w:02d}"


def test_panel_of_a_small_fixture(spark):
    weeks = ["2026-W01"] * 3 + ["2026-W02"] * 4
    processed = spark.createDataFrame([(i, w, "COMPLETED", "UNIQUE") for i, w in enumerate(weeks)] + [(90, "2026-W01", "COMPLETED", "EXACT_DUPLICATE"), (91, None, "COMPLETED", "UNIQUE"), (92, "2026-W01", "FAILED", None)], PROC)
    labels = ["negative", "negative", "positive", "neutral", "positive", "negative", None]
    scores = [0.9, 0.6, 0.6, 0.5, 0.4, 0.4, None]
    sentiment = spark.createDataFrame([(i, x, s) for i, (x, s) in enumerate(zip(labels, scores)) if x], "article_id long, sentiment string, sentiment_score double")
    topics = spark.createDataFrame([(0, "Fuel & Oil Prices (CPC)"), (3, "Fuel & Oil Prices (CPC)"), (4, "Fuel Quota & QR System")], "article_id long, topic_name string")
    keywords = spark.createDataFrame([(0, "Fuel queue"), (0, "fuel"), (3, "FUEL"), (4, "fuel crisis"), (4, None)], "article_id long, keyword string")
    entities = spark.createDataFrame([(0, "ORGANIZATION"), (0, "PERSON"), (3, "ORGANIZATION"), (3, "X")], "article_id long, entity_type string")
    panel = weekly_panel(article_dataset(processed, sentiment, topics), child_dataset(processed, keywords, "keyword"), child_dataset(processed, entities, "entity_type"))
    rows = {r.week: r for r in add_trends(panel).collect()}
    a, b = rows["2026-W01"], rows["2026-W02"]
    assert (a.article_count, b.article_count) == (3, 4)
    assert a.average_sentiment == pytest.approx(-0.3) and a.negative_sentiment_ratio == pytest.approx(2 / 3)
    assert (a.fuel_topic_frequency, b.fuel_topic_frequency) == (1, 2)
    assert (a.fuel_keyword_frequency, b.fuel_keyword_frequency, b.crisis_keyword_frequency) == (1, 2, 1)
    assert (a.organization_entity_frequency, a.person_entity_frequency, b.organization_entity_frequency) == (1, 1, 1)
    assert a.article_count_change is None and b.article_count_change == pytest.approx(1 / 3)
    assert b.topic_growth_rate == pytest.approx(1.0) and a.ma_4week is None


def test_anomaly_by_hand(spark):
    fuel = [2, 0, 3, 1, 0, 3, 0, 5, 13, 14, 21, 61, 31, 13]
    rows = [(f"2026-W{i + 2:02d}", 10, 0.5, x) for i, x in enumerate(fuel)]
    panel = spark.createDataFrame(rows, "week string, article_count int, negative_sentiment_ratio double, fuel_topic_frequency int")
    got = {r.week: r.anomaly_score for r in anomaly_scores(panel).collect()}
    past = np.array(fuel[2:10], float)
    assert got["2026-W02"] is None and got["2026-W09"] is None
    assert got["2026-W12"] == pytest.approx((21 - past.mean()) / past.std(ddof=1))
    assert {r.anomaly_score for r in anomaly_scores(panel, ["nothing"]).collect()} == {None}
    assert anomaly_scores(panel, ["fuel_topic_frequency"]).count() == 14


def walk(monday, events, window=30):
    active = before = nearest = None
    for e, start, end in events:
        days = (monday - start).days
        if monday <= (end or start) and monday + timedelta(6) >= start:
            active = (e, days)
        if -window <= days < 0 and (before is None or abs(days) < abs(before[1])):
            before = (e, days)
        if nearest is None or abs(days) < abs(nearest[1]):
            nearest = (e, days)
    return (*active, None) if active else (*before, 1) if before else (*nearest, 0)


def test_labels_equal_a_walk(spark):
    rng = random.Random(2)
    mondays = [date(2024, 1, 1) + timedelta(7 * i) for i in range(60)]
    weeks = spark.createDataFrame([(week(m),) for m in mondays] + [(week(mondays[0]),), ("bad",), (None,)], "week string")
    for _ in range(3):
        events = []
        for e in range(1, 6):
            start = date(2024, 1, 1) + timedelta(rng.randrange(400))
            events.append((e, start, None if rng.random() < 0.3 else start + timedelta(rng.randrange(40))))
        df = spark.createDataFrame([(e, f"e{e}", s, x) for e, s, x in events], "event_id int, event_name string, start_date date, end_date date")
        got = {r.week: (r.crisis_event, r.days_to_crisis, r.label_pre_crisis) for r in label_weeks(weeks, df).collect()}
        assert got == {week(m): walk(m, events) for m in mondays}


def test_lead_time(spark):
    events = spark.createDataFrame([(1, "A", date(2026, 2, 28)), (2, "B", date(2026, 6, 1))], "event_id int, event_name string, start_date date")
    rows = [("2026-W08", 1, "m", 1, 0.9), ("2026-W07", 1, "m", 1, 0.6), ("2026-W06", 1, "m", 1, 0.4), ("2026-W05", 1, "m", 0, 0.9), ("2026-W07", 2, "other", 1, 0.9)]
    found = lead_times(spark.createDataFrame(rows, "week string, crisis_event int, model string, true_label int, predicted_proba double"), events, 0.5, "m")
    assert {r.event_name: (r.first_detection_week, r.lead_time_days) for r in found.collect()} == {"A": ("2026-W07", 19), "B": (None, None)}


def test_binary_metrics_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [("x", rng.random() < 0.3, round(rng.random(), 1)) for _ in range(200)] + [("one", True, 0.2)]
    df = spark.createDataFrame([(k, int(y), s) for k, y, s in rows] + [("x", None, 0.5), ("x", 1, None)], "k string, label int, score double")
    got = {r.k: r for r in binary_metrics(df, ["k"]).collect()}
    x = [(y, s) for k, y, s in rows if k == "x"]
    pos, neg = [s for y, s in x if y], [s for y, s in x if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ap = sum(sum(q >= p for q in pos) / sum(s >= p for _, s in x) for p in pos) / len(pos)
    assert got["x"].roc_auc == pytest.approx(auc) and got["x"].pr_auc == pytest.approx(ap)
    assert got["x"].tp == sum(s >= 0.5 for s in pos)
    assert (got["one"].precision, got["one"].recall, got["one"].roc_auc) == (0.0, 0.0, None)
    mean = fold_averages(binary_metrics(df, ["k"]).withColumn("m", F.lit("a")), ["m"]).first()
    assert mean.roc_auc == pytest.approx(auc) and mean.recall == pytest.approx(got["x"].recall / 2)
    assert binary_metrics(df.limit(0), ["k"]).count() == 0


def test_class_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", None), ("z", "a")], "truth string, guess string")
    got = {r.label: r for r in class_metrics(df, ["a", "b"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["b"].precision, got["accuracy"].f1) == (1.0, 0.5, 0.5, 0.5)
    assert {r.truth: (r.a, r.b) for r in confusion(df, ["a", "b"]).collect()} == {"a": (1, 1), "b": (0, 1)}
