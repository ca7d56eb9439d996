import hashlib
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from presswell.functions import dates, text
from presswell.functions.scoring import cosine, entity_type, sentiment_label, signed_sentiment, topic_name
from presswell.operators.validate import validate


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [
    (None, ""), ("", ""), ("   \n ", ""),
    ("<p><b>Fuel</b> prices <i>rise</i> .</p>", "Fuel prices rise."),
    ("a  b\n\n c\t\td", "a b c d"),
    ("a b c", "a b c"),
    ("Prices rose. Follow us on Facebook for more", "Prices rose."),
    ("One.\nALSO READ: another\nTwo.", "One. Two."),
    ("donâ€™t", "don’t"),
    ("x <script>var a = '</p>';</script> y", "x y"),
    ("Fish &amp; chips <b>now</b>", "Fish & chips now"),
    ("Fish &amp; chips", "Fish &amp; chips"),
])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


@pytest.mark.parametrize("raw,words,sentences", [("One here. Two! Three?", 4, 3), ("", 0, 0), (None, 0, 0), ("no end", 2, 1), ("  ", 0, 0), ("a. b." * 50_000, 50_001, 50_001)])
def test_counts(spark, raw, words, sentences):
    assert one(spark, raw, text.word_count) == words
    assert one(spark, raw, text.sentence_count) == sentences


@pytest.mark.parametrize("raw", ["Same  Text\n here ", "É clair", "", None])
def test_content_hash_equals_plain_code(spark, raw):
    want = hashlib.sha256(re.sub(r"\s+", " ", raw or "").strip().lower().encode()).hexdigest()
    assert one(spark, raw, text.content_hash) == want


@pytest.mark.parametrize("raw,want", [
    ("01 Apr 2026", date(2026, 4, 1)), ("1 Apr 2026", date(2026, 4, 1)), ("01 APR 2026", date(2026, 4, 1)), ("  21  Nov 2023", date(2023, 11, 21)),
    ("31 Feb 2026", None), ("01 April 2026", None), ("001 Apr 2026", None), ("2026-04-01", None), ("not a date at all", None), ("", None), (None, None),
])
def test_parse_date(spark, raw, want):
    assert one(spark, raw, dates.parse_date) == want


def test_iso_weeks_there_and_back(spark):
    days = [date(2015, 1, 1) + timedelta(d) for d in range(0, 7000, 3)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", dates.iso_week(F.col("d")).alias("w")).withColumn("m", dates.week_monday(F.col("w"))).collect()
    for r in rows:
        y, w, _ = r.d.isocalendar()
        assert r.w == f"{y}-W{w:02d}"
        assert r.m == r.d - timedelta(r.d.weekday())


def test_week_monday_of_other_texts(spark):
    assert all(one(spark, x, dates.week_monday) is None for x in ("2024-13", "", None, "2024-W54", "x2024-W01"))


def test_validation_order(spark):
    long = "x" * 60
    rows = [
        (1, "t", long, "d", "l"), (2, "t", None, "d", "l"), (3, "", "short", "d", "l"), (4, "t", "  ", "d", "l"), (5, "t", "short", "d", "l"),
        (None, "t", long, "d", "l"), (7, "t", long, None, None), (8, "t", " " * 60, "d", "l"),
    ]
    found = validate(spark.createDataFrame(rows, "id long, title string, content string, date string, link string")).collect()
    assert [r.reason for r in found] == ["", "MISSING_FIELD:content", "EMPTY_TITLE", "EMPTY_CONTENT", "CONTENT_TOO_SHORT:5chars", "MISSING_FIELD:id", "MISSING_FIELD:date", "EMPTY_CONTENT"]


def test_scores(spark):
    rows = spark.createDataFrame([("positive", 0.5), ("negative", 0.5), ("neutral", 0.5), (None, None), ("positive", None)], "l string, s double")
    assert [r.v for r in rows.select(signed_sentiment(F.col("l"), F.col("s")).alias("v")).collect()] == [0.5, -0.5, 0.0, 0.0, 0.0]
    assert one(spark, "LABEL_0", sentiment_label) == "negative" and one(spark, " Positive ", sentiment_label) == "positive"
    assert one(spark, "GPE", entity_type) == "LOCATION" and one(spark, "DATE", entity_type) is None
    vectors = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.c for r in vectors.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None
    names = spark.createDataFrame([(-1, ["a"]), (2, []), (3, ["a", "b", "c", "d"])], "t int, w array<string>").select(topic_name(F.col("t"), F.col("w")).alias("n"))
    assert [r.n for r in names.collect()] == ["outlier_uncategorized", "topic_2", "a_b_c"]


@pytest.mark.parametrize("raw,kind", [
    ("2026-04-01", "ISO_DATE (YYYY-MM-DD...)"), (" 2026-04-01T10:00 ", "ISO_DATE (YYYY-MM-DD...)"), ("1 hour ago", "N hours ago"), ("12 HOURS ago", "N hours ago"),
    ("3 days ago", "N days ago"), ("1 minute ago", "N minutes ago"), ("Yesterday", "Yesterday/Today keyword"), (" today ", "Yesterday/Today keyword"), ("April 1, 2026", "Month DD, YYYY"),
    ("Apr 01 2026", "Month DD, YYYY"), ("", "EMPTY/NULL"), ("  ", "EMPTY/NULL"), (None, "EMPTY/NULL"), ("None", "EMPTY/NULL"), ("nan", "EMPTY/NULL"),
    ("01 Apr 2026", "OTHER/UNRECOGNIZED"), ("01/04/2026", "OTHER/UNRECOGNIZED"), ("3 weeks ago", "OTHER/UNRECOGNIZED"), ("2026-4-1", "OTHER/UNRECOGNIZED"),
])
def test_date_patterns(spark, raw, kind):
    from presswell.functions.dates import date_pattern

    assert spark.createDataFrame([(raw,)], "d string").select(date_pattern(F.col("d")).alias("k")).first().k == kind
