"""Registered queries of the general problems and their SQL twins."""

from __future__ import annotations

from presswell.plans import incremental, rolling

QUERIES = {
    "p1_found": incremental.p1_found,
    "p1_delivered": incremental.p1_delivered,
    "p1_runs": incremental.p1_runs,
    "p4_found": rolling.p4_found,
    "p4_weekly": rolling.p4_weekly,
    "p4_entities": rolling.p4_entities,
    "p4_entity_days": rolling.p4_entity_days,
}

_P1 = """
WITH raw AS (
  SELECT id, title, content, date FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC NULLS LAST) AS r FROM scraped_news WHERE id IS NOT NULL) WHERE r = 1),
done AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY processing_timestamp DESC NULLS LAST) AS r FROM processed_news) WHERE r = 1)
SELECT raw.id AS article_id {extra}
FROM raw LEFT JOIN done ON raw.id = done.article_id
WHERE done.article_id IS NULL OR done.processing_status IS DISTINCT FROM 'COMPLETED'
   OR raw.title IS DISTINCT FROM done.title_original
   OR raw.content IS DISTINCT FROM done.content_original
   OR raw.date IS DISTINCT FROM done.date_raw
"""

_P1_RUNS = """
WITH raw AS (
  SELECT id, title, content, date,
    row_number() OVER (PARTITION BY id ORDER BY scraped_at NULLS FIRST) AS a, row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC NULLS LAST) AS z
  FROM scraped_news WHERE id IS NOT NULL),
f AS (SELECT * FROM raw WHERE a = 1), n AS (SELECT * FROM raw WHERE z = 1),
done AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY processing_timestamp DESC NULLS LAST) AS r FROM processed_news) WHERE r = 1)
SELECT f.id AS article_id, 1 AS run, CAST(1 AS BIGINT) AS deliveries FROM f LEFT JOIN done ON f.id = done.article_id
WHERE done.article_id IS NULL OR done.processing_status IS DISTINCT FROM 'COMPLETED'
   OR f.title IS DISTINCT FROM done.title_original OR f.content IS DISTINCT FROM done.content_original OR f.date IS DISTINCT FROM done.date_raw
UNION ALL
SELECT n.id, 2, CAST(1 AS BIGINT) FROM n JOIN f USING (id)
WHERE n.title IS DISTINCT FROM f.title OR n.content IS DISTINCT FROM f.content OR n.date IS DISTINCT FROM f.date
"""

_P4 = """
WITH cur AS (
  SELECT series, week, article_count, ma_4week, ma_8week,
    CAST(date_trunc('week', make_date(CAST(substr(week, 1, 4) AS INTEGER), 1, 4)) AS DATE) + 7 * (CAST(substr(week, 7, 2) AS INTEGER) - 1) AS monday
  FROM (SELECT *, row_number() OVER (PARTITION BY series, week ORDER BY computed_at DESC NULLS LAST) AS r FROM temporal_features) WHERE r = 1),
span AS (SELECT series, min(monday) AS a, max(monday) AS b FROM cur GROUP BY series),
cal AS (SELECT series, a, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS monday FROM span),
dense AS (
  SELECT cal.series, cal.monday, cal.a, cur.week IS NOT NULL AS present, cur.article_count, cur.ma_4week, cur.ma_8week
  FROM cal LEFT JOIN cur ON cur.series = cal.series AND cur.monday = cal.monday),
sums AS (
  SELECT *, CASE WHEN monday >= a + 21 THEN sum(coalesce(article_count, 0)) OVER (PARTITION BY series ORDER BY monday ROWS 3 PRECEDING) / 4.0 END AS right_4,
            CASE WHEN monday >= a + 49 THEN sum(coalesce(article_count, 0)) OVER (PARTITION BY series ORDER BY monday ROWS 7 PRECEDING) / 8.0 END AS right_8
  FROM dense)
"""

_ENTITIES = """
WITH cur AS (
  SELECT article_id, publication_date FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY processing_timestamp DESC NULLS LAST, publication_date DESC NULLS LAST) AS r FROM processed_news) WHERE r = 1),
names AS (SELECT article_id, lower(trim(regexp_replace(entity, '\\s+', ' ', 'g'))) AS entity FROM (SELECT DISTINCT article_id, entity, entity_type, confidence FROM article_entities)),
d AS (SELECT entity, publication_date, count(*) AS mentions FROM names JOIN cur USING (article_id) WHERE publication_date IS NOT NULL AND entity <> '' GROUP BY ALL),
"""

_ENTITY_TOTALS = """
cal AS (SELECT entity, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST((SELECT max(publication_date) FROM cur) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS publication_date FROM span),
dense AS (SELECT entity, publication_date, CAST(coalesce(mentions, 0) AS BIGINT) AS mentions FROM cal LEFT JOIN d USING (entity, publication_date)),
s AS (SELECT *, CAST(sum(mentions) OVER (PARTITION BY entity ORDER BY publication_date ROWS 6 PRECEDING) AS BIGINT) AS total_7,
  CAST(sum(mentions) OVER (PARTITION BY entity ORDER BY publication_date ROWS 29 PRECEDING) AS BIGINT) AS total_30 FROM dense)
SELECT *, round(total_7 / 7.0, 6) AS average_7, round(total_30 / 30.0, 6) AS average_30 FROM s
"""

ORACLE = {
    "p1_found": _P1.format(extra=""),
    "p1_delivered": _P1.format(extra=", CAST(1 AS BIGINT) AS deliveries"),
    "p1_runs": _P1_RUNS,
    "p4_found": _P4
    + """
SELECT series, strftime(monday, '%G-W%V') AS week FROM sums
WHERE present AND (coalesce(abs(ma_4week - right_4) > 0.01, (ma_4week IS NULL) <> (right_4 IS NULL))
                OR coalesce(abs(ma_8week - right_8) > 0.01, (ma_8week IS NULL) <> (right_8 IS NULL)))
""",
    "p4_weekly": _P4
    + """
SELECT series, strftime(monday, '%G-W%V') AS week, present, article_count, round(right_4, 6) AS right_4, round(right_8, 6) AS right_8,
  round(ma_4week, 6) AS ma_4week, round(ma_8week, 6) AS ma_8week FROM sums
""",
    "p4_entities": _ENTITIES
    + """
span AS (SELECT entity, min(publication_date) AS a FROM d GROUP BY entity),"""
    + _ENTITY_TOTALS,
    "p4_entity_days": _ENTITIES
    + """
span AS (SELECT DISTINCT entity, (SELECT min(publication_date) FROM cur) AS a FROM names WHERE entity <> ''),"""
    + _ENTITY_TOTALS,
}
