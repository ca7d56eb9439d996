"""SQL twins of the registered news queries."""

from __future__ import annotations

from presswell import config
from presswell.operators.enrich import ENTITY_PATTERNS


def _in(names: list[str]) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


_WEEK = "strftime({}, '%G-W%V')"
_MONDAY = "(CAST(date_trunc('week', make_date(CAST(substr({0}, 1, 4) AS INTEGER), 1, 4)) AS DATE) + 7 * (CAST(substr({0}, 7, 2) AS INTEGER) - 1))"
_SPACE = "[ \\t\\n\\x0B\\f\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _newest(table: str, keys: str, order: str, columns: str = "*", more: str = "") -> str:
    return f"(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC NULLS LAST) AS rn FROM {table} WHERE {keys.split(',')[0]} IS NOT NULL) WHERE rn = 1 {more})"


RAW = _newest("scraped_news", "id", "scraped_at")
PROCESSED = _newest("processed_news", "article_id", "processing_timestamp")
COMPLETED = _newest("processed_news", "article_id", "processing_timestamp", more="AND processing_status = 'COMPLETED'")
WEEKLY = _newest("temporal_features", "series, week", "computed_at")

_ARTICLES = f"""articles AS (
  SELECT o_orderkey AS article_id, {_WEEK.format('o_orderdate')} AS week,
    CASE o_orderstatus WHEN 'F' THEN 'negative' WHEN 'P' THEN 'positive' ELSE 'neutral' END AS sentiment,
    o_totalprice / 500000 AS score, o_orderpriority AS topic_name FROM orders)"""


def _tagless(out: str) -> str:
    tags = f"regexp_replace(regexp_replace({out}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        tags = f"replace({tags}, '{entity}', '{char}')"
    return f"(CASE WHEN contains({out}, '<') OR contains({out}, '>') THEN {tags} ELSE {out} END)"


def _clean(column: str) -> str:
    out = f"coalesce({column}, '')"
    for bad, good in config.ENCODING_REPAIRS.items():
        out = f"replace({out}, '{bad}', '{good}')"
    stripped = _tagless(out)
    body = f"regexp_replace({stripped}, '(?i){'|'.join(p for p in config.BOILERPLATE)}', '', 'g')"
    one = f"regexp_replace({body}, '{_SPACE}+', ' ', 'g')"
    return f"regexp_replace(trim({one}), '{_SPACE}+([.,!?;:])', '\\1', 'g')"


def _tokens(column: str) -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _count(tokens: str, words: tuple) -> str:
    return f"len(list_filter({tokens}, lambda x: x IN {_in(list(words))}))"


def _lexicon(column: str) -> tuple[str, str]:
    p, n = _count(_tokens(column), config.POSITIVE), _count(_tokens(column), config.NEGATIVE)
    return f"CASE WHEN {p} > {n} THEN 'positive' WHEN {n} > {p} THEN 'negative' ELSE 'neutral' END", f"coalesce(abs({p} - {n}) / nullif({p} + {n}, 0), 0.0)"


def _panel(topics, keywords, entities) -> str:
    t = ", ".join(f"CAST(count(*) FILTER (topic_name IN {_in(n)}) AS INTEGER) AS {c}" for c, n in topics.items())
    k = ", ".join(f"CAST(count(DISTINCT CASE WHEN contains(lower(p_name), '{s}') THEN l_orderkey END) AS INTEGER) AS {c}" for c, s in keywords.items())
    e = ", ".join(f"CAST(count(*) FILTER (l_returnflag = '{s}') AS INTEGER) AS {c}" for c, s in entities.items())
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*keywords, *entities])
    base = ", ".join(["article_count", "average_sentiment", "negative_sentiment_ratio", "positive_sentiment_ratio", *topics])
    return f"""WITH {_ARTICLES},
base AS (SELECT week, CAST(count(*) AS INTEGER) AS article_count,
  avg(CASE sentiment WHEN 'positive' THEN score WHEN 'negative' THEN -score ELSE 0 END) AS average_sentiment,
  count(*) FILTER (sentiment = 'negative') / count(*) AS negative_sentiment_ratio, count(*) FILTER (sentiment = 'positive') / count(*) AS positive_sentiment_ratio, {t}
  FROM articles GROUP BY week),
kw AS (SELECT week, {k} FROM lineitem JOIN articles ON l_orderkey = article_id JOIN part ON p_partkey = l_partkey GROUP BY week),
en AS (SELECT week, {e} FROM lineitem JOIN articles ON l_orderkey = article_id GROUP BY week),
panel AS (SELECT week, {base}, {zero} FROM base LEFT JOIN kw USING (week) LEFT JOIN en USING (week))"""


def _round(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_RATES = ("article_count_change", "sentiment_change", "topic_growth_rate", "keyword_growth_rate", "entity_growth_rate", "ma_4week", "ma_8week")


def _trends(source: str, sums: tuple[str, str, str], by: str = "") -> str:
    over = f"OVER ({by} ORDER BY week)"
    change = lambda x: f"(CAST({x} AS DOUBLE) - lag(CAST({x} AS DOUBLE)) {over}) / nullif(lag(CAST({x} AS DOUBLE)) {over}, 0)"
    ma = lambda n: f"CASE WHEN count(article_count) OVER ({by} ORDER BY week ROWS {n - 1} PRECEDING) = {n} THEN avg(article_count) OVER ({by} ORDER BY week ROWS {n - 1} PRECEDING) END"
    growth = ", ".join(f"{change(s)} AS {c}" for s, c in zip(sums, ("topic_growth_rate", "keyword_growth_rate", "entity_growth_rate"), strict=True))
    return f"trends AS (SELECT *, {change('article_count')} AS article_count_change, average_sentiment - lag(average_sentiment) {over} AS sentiment_change, {growth}, {ma(4)} AS ma_4week, {ma(8)} AS ma_8week FROM {source})"


def _anomaly(source: str, metrics: list[str], by: str = "") -> str:
    frame = f"OVER ({by} ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"
    z = [f"CASE WHEN count({m}) {frame} = 8 AND stddev_samp({m}) {frame} > 0 THEN abs(({m} - avg({m}) {frame}) / stddev_samp({m}) {frame}) END" for m in metrics]
    return f"scored AS (SELECT *, greatest({', '.join(z)}) AS anomaly_score FROM {source})"


def _labels(weeks: str, events: str) -> str:
    return f"""met AS (SELECT w.week, w.monday, e.event_id, e.start_date, coalesce(e.end_date, e.start_date) AS last, date_diff('day', e.start_date, w.monday) AS days
  FROM (SELECT DISTINCT week, CAST({_MONDAY.format('week')} AS DATE) AS monday FROM {weeks}) w, {events} e),
place AS (SELECT *, monday <= last AND monday + 6 >= start_date AS active, days >= -30 AND days < 0 AS near FROM met),
pick AS (SELECT week,
  max(CASE WHEN active THEN event_id END) AS active_id,
  min(CASE WHEN near THEN struct_pack(d := abs(days), e := event_id, x := days) END) AS b,
  min(struct_pack(d := abs(days), e := event_id, x := days)) AS n FROM place GROUP BY week),
labels AS (SELECT pick.week,
  CAST(CASE WHEN active_id IS NOT NULL THEN active_id WHEN b IS NOT NULL THEN b.e ELSE n.e END AS INTEGER) AS crisis_event,
  CAST(CASE WHEN active_id IS NOT NULL THEN (SELECT p.days FROM place p WHERE p.week = pick.week AND p.event_id = active_id) WHEN b IS NOT NULL THEN b.x ELSE n.x END AS INTEGER) AS days_to_crisis,
  CASE WHEN active_id IS NOT NULL THEN NULL WHEN b IS NOT NULL THEN 1 ELSE 0 END AS label_pre_crisis FROM pick)"""


def _date(column: str) -> str:
    text = f"regexp_replace(regexp_replace({column}, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g')"
    return f"CASE WHEN regexp_matches({text}, '^(?i)[0-9]{{1,2}} [a-z]{{3}} [0-9]{{4}}$') THEN CAST(try_strptime({text}, '%d %b %Y') AS DATE) END"


_REASON = f"""CASE WHEN id IS NULL THEN 'MISSING_FIELD:id' WHEN title IS NULL THEN 'MISSING_FIELD:title' WHEN content IS NULL THEN 'MISSING_FIELD:content'
  WHEN date IS NULL THEN 'MISSING_FIELD:date' WHEN link IS NULL THEN 'MISSING_FIELD:link'
  WHEN regexp_full_match(title, '{_SPACE}*') THEN 'EMPTY_TITLE' WHEN regexp_full_match(content, '{_SPACE}*') THEN 'EMPTY_CONTENT'
  WHEN length(regexp_replace(content, '^{_SPACE}+|{_SPACE}+$', '', 'g')) < 50 THEN 'CONTENT_TOO_SHORT:' || length(regexp_replace(content, '^{_SPACE}+|{_SPACE}+$', '', 'g')) || 'chars' ELSE '' END"""

_HASH = f"sha256(lower(trim(regexp_replace(coalesce(content_clean, ''), '{_SPACE}+', ' ', 'g'))))"

_LINKED = f"""linked AS (SELECT c.article_id, r.link, {_HASH.replace('content_clean', 'c.content_clean')} AS h, c.publication_date, c.content_clean FROM {COMPLETED} c LEFT JOIN {RAW} r ON r.id = c.article_id),
by_link AS (SELECT *, CASE WHEN link IS NOT NULL AND link <> '' THEN min(article_id) OVER (PARTITION BY link) END AS first_link FROM linked),
left_over AS (SELECT *, coalesce(first_link < article_id, false) AS dup FROM by_link),
by_hash AS (SELECT *, CASE WHEN NOT dup THEN min(CASE WHEN NOT dup THEN article_id END) OVER (PARTITION BY h) END AS first_hash FROM left_over),
exact AS (SELECT article_id, publication_date, content_clean, CASE WHEN dup OR first_hash < article_id THEN 'EXACT_DUPLICATE' ELSE 'UNIQUE' END AS duplicate_status,
  CASE WHEN dup THEN first_link WHEN first_hash < article_id THEN first_hash END AS duplicate_of FROM by_hash)"""


def _pairs(source: str) -> str:
    """Same-day cosine pairs over (doc, day, text)."""
    return f"""toks AS (SELECT day, doc, unnest({_tokens('text')}) AS term FROM {source} WHERE day IS NOT NULL),
tf AS (SELECT day, doc, term, count(*) AS tf FROM toks WHERE term NOT IN {_in(list(config.STOPWORDS))} GROUP BY ALL),
terms AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, term) AS r FROM (SELECT day, term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY ALL)),
sizes AS (SELECT day, count(*) AS docs FROM {source} WHERE day IS NOT NULL GROUP BY day),
raw_w AS (SELECT tf.day, tf.doc, tf.term, tf.tf * (ln((1 + docs) / (1 + df)) + 1) AS w FROM tf JOIN terms ON tf.day = terms.day AND tf.term = terms.term AND r <= {config.MAX_DAY_TERMS} JOIN sizes ON sizes.day = tf.day),
w AS (SELECT day, doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM raw_w),
pairs AS (SELECT x.doc AS a, y.doc AS b, sum(x.w * y.w) AS similarity FROM w x JOIN w y ON x.day = y.day AND x.term = y.term AND x.doc < y.doc GROUP BY ALL HAVING sum(x.w * y.w) >= {config.NEAR_DUPLICATE_COSINE} - 1e-12)"""


_GREEDY = """walk AS (
  SELECT 0 AS step, CAST([] AS BIGINT[]) AS marked, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS found
  UNION ALL
  SELECT step + 1, CASE WHEN list_contains(marked, a) OR list_contains(marked, b) THEN marked ELSE list_append(marked, b) END,
    CASE WHEN list_contains(marked, a) OR list_contains(marked, b) THEN found ELSE list_append(found, struct_pack(a := a, b := b)) END
  FROM walk JOIN numbered ON numbered.n = walk.step + 1),
marks AS (SELECT unnest(found) AS m FROM (SELECT found FROM walk ORDER BY step DESC LIMIT 1))"""


def oracle(topics: dict, keywords: dict, entities: dict, metrics: list[str], events: str) -> dict[str, str]:
    panel = _panel(topics, keywords, entities)
    ratios = ("average_sentiment", "negative_sentiment_ratio", "positive_sentiment_ratio")
    base_cols = f"week, article_count, {_round(*ratios)}, {', '.join(topics)}"
    panel_cols = f"{base_cols}, {', '.join([*keywords, *entities])}"
    sums = tuple(" + ".join(x).join("()") for x in (topics, keywords, entities))
    trends, anomaly = _trends("panel", sums), _anomaly("panel", metrics)
    ev = f"ev AS (SELECT * FROM (VALUES {events}) AS t(event_id, event_name, start_date, end_date))"
    label, score = _lexicon("content_clean")
    truth, _ = _lexicon("title_clean")
    texts = f"src AS (SELECT article_id AS doc, publication_date AS day, content_clean AS text FROM {COMPLETED})"
    numbered = "numbered AS (SELECT *, row_number() OVER (ORDER BY a, b) AS n FROM pairs)"
    entity_union = " UNION ALL ".join(
        f"SELECT article_id, unnest(regexp_extract_all(coalesce(content_clean, ''), '{p.replace(chr(39), chr(39) * 2)}', 1)) AS entity, '{config.ENTITY_TYPES[kind]}' AS entity_type FROM {COMPLETED}" for kind, p in ENTITY_PATTERNS
    )
    areas = """r AS (SELECT k, label, score, rank() OVER (PARTITION BY k ORDER BY score) + (count(*) OVER (PARTITION BY k, score) - 1) / 2 AS avg_rank,
    count(*) FILTER (label = 1) OVER (PARTITION BY k ORDER BY score DESC) AS tp, count(*) OVER (PARTITION BY k ORDER BY score DESC) AS seen FROM s),
m AS (SELECT k, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn,
    count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 1) AS ps, count(*) FILTER (label = 0) AS ns,
    sum(CASE WHEN label = 1 THEN avg_rank END) AS ranks, sum(CASE WHEN label = 1 THEN r.tp / seen END) AS ap FROM r GROUP BY k),
b AS (SELECT k, tn, fp, fn, tp, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1,
    CASE WHEN ps > 0 AND ns > 0 THEN (ranks - ps * (ps + 1) / 2) / ps / ns END AS roc_auc, CASE WHEN ps > 0 AND ns > 0 THEN ap / ps END AS pr_auc FROM m)"""
    spelling = f"regexp_replace(date, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    pattern = f"""CASE WHEN regexp_full_match({spelling}, '\\d{{4}}-\\d{{2}}-\\d{{2}}.*') THEN 'ISO_DATE (YYYY-MM-DD...)'
  WHEN regexp_full_match({spelling}, '(?i)\\d+\\s+hours?\\s+ago') THEN 'N hours ago' WHEN regexp_full_match({spelling}, '(?i)\\d+\\s+days?\\s+ago') THEN 'N days ago'
  WHEN regexp_full_match({spelling}, '(?i)\\d+\\s+minutes?\\s+ago') THEN 'N minutes ago' WHEN lower({spelling}) IN ('yesterday', 'today') THEN 'Yesterday/Today keyword'
  WHEN regexp_full_match({spelling}, '[A-Za-z]+\\s+\\d{{1,2}},?\\s+\\d{{4}}') THEN 'Month DD, YYYY'
  WHEN date IS NULL OR lower({spelling}) IN ('', 'none', 'nan') THEN 'EMPTY/NULL' ELSE 'OTHER/UNRECOGNIZED' END"""
    classes = """c AS (SELECT 'negative' AS label UNION ALL SELECT 'neutral' UNION ALL SELECT 'positive'),
x AS (SELECT c.label, count(*) FILTER (truth = c.label AND guess = c.label) AS tp, count(*) FILTER (guess = c.label) AS called, count(*) FILTER (truth = c.label) AS support FROM g, c GROUP BY c.label),
y AS (SELECT label, coalesce(tp / nullif(called, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall, coalesce(2 * tp / nullif(called + support, 0), 0.0) AS f1, CAST(support AS BIGINT) AS support, tp FROM x)"""
    population = "p.processing_status = 'COMPLETED' AND p.duplicate_status <> 'EXACT_DUPLICATE' AND p.publication_week IS NOT NULL"
    out = {
        "weekly_base_metrics": f"{panel} SELECT {base_cols} FROM panel",
        "weekly_panel_full": f"{panel} SELECT {panel_cols} FROM panel",
        "weekly_trends": f"{panel}, {trends} SELECT {panel_cols}, {_round(*_RATES)} FROM trends",
        "weekly_anomaly": f"{panel}, {anomaly} SELECT week, {_round('anomaly_score')} FROM scored",
        "top_anomalous_weeks": f"{panel}, {anomaly} SELECT week, article_count, {_round('anomaly_score')} FROM scored ORDER BY round(scored.anomaly_score, 6) DESC NULLS LAST, week LIMIT 10",
        "event_window_labels": f"{panel}, {ev}, {_labels('panel', 'ev')} SELECT * FROM labels",
        "full_signal_panel": f"{panel}, {ev}, {_labels('panel', 'ev')}, {trends}, {_anomaly('trends', metrics)} SELECT {panel_cols}, {_round(*_RATES, 'anomaly_score')}, crisis_event, days_to_crisis, label_pre_crisis FROM scored JOIN labels USING (week)",
        "event_labels_series": f"WITH wk AS {WEEKLY}, {_labels('wk', 'crisis_events')} SELECT series, week, labels.crisis_event, labels.days_to_crisis, labels.label_pre_crisis FROM wk JOIN labels USING (week)",
        "series_trends": f"WITH wk AS (SELECT series, week, article_count, average_sentiment FROM {WEEKLY}), {_trends('wk', ('1', '1', '1'), 'PARTITION BY series')} SELECT series, week, {_round('article_count_change', 'sentiment_change', 'ma_4week', 'ma_8week')} FROM trends",
        "series_anomaly": f"WITH wk AS (SELECT series, week, {', '.join(metrics)} FROM {WEEKLY}), {_anomaly('wk', metrics, 'PARTITION BY series')} SELECT series, week, {_round('anomaly_score', digits=4)} FROM scored",
        "keyword_distinct_articles": f"{panel} SELECT * FROM kw",
        "entity_row_counts": f"{panel} SELECT * FROM en",
        "validate_articles": f"SELECT id, {_REASON} AS reason, {_REASON} = '' AS is_valid FROM {RAW}",
        "date_normalization": f"""WITH d AS (SELECT id, {_date('date')} AS p FROM {RAW})
SELECT id, strftime(CAST(p AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS published_at, p AS publication_date, CAST(year(p) AS INTEGER) AS publication_year, CAST(month(p) AS INTEGER) AS publication_month, {_WEEK.format('p')} AS publication_week,
  CAST(day(p) AS INTEGER) AS publication_day, CASE WHEN p IS NULL THEN 'FAILED' ELSE 'OK' END AS date_parse_status FROM d""",
        "week_to_monday": f"SELECT DISTINCT week, CAST({_MONDAY.format('week')} AS DATE) AS monday FROM {WEEKLY}",
        "clean_articles": f"SELECT id, {_clean('content')} AS content_clean, {_clean('title')} AS title_clean FROM {RAW}",
        "strip_html": f"SELECT id, {_tagless('content')} AS content FROM {RAW}",
        "text_features": f"""SELECT article_id, CAST(len(list_filter(regexp_split_to_array(coalesce(content_clean, ''), '{_SPACE}+'), lambda x: x <> '')) AS INTEGER) AS words,
  CAST(length(coalesce(content_clean, '')) AS INTEGER) AS chars,
  CAST(CASE WHEN regexp_full_match(coalesce(content_clean, ''), '{_SPACE}*') THEN 0 ELSE 1 + len(regexp_extract_all(content_clean, '[.!?]{_SPACE}+[^ \\t\\n\\x0B\\f\\r]')) END AS INTEGER) AS sentences FROM {COMPLETED}""",
        "content_hashes": f"SELECT article_id, {_HASH} AS content_hash FROM {COMPLETED}",
        "exact_duplicates_link_then_hash": f"WITH {_LINKED} SELECT article_id, duplicate_status, duplicate_of FROM exact",
        "near_duplicate_pairs": f"WITH {texts}, {_pairs('src')} SELECT a, b, {_round('similarity')} FROM pairs",
        "near_duplicates_greedy": f"WITH RECURSIVE {texts}, {_pairs('src')}, {numbered}, {_GREEDY} SELECT m.b AS article_id, m.a AS duplicate_of FROM marks",
        "duplicate_status": f"""WITH RECURSIVE {_LINKED}, src AS (SELECT article_id AS doc, publication_date AS day, content_clean AS text FROM exact WHERE duplicate_status = 'UNIQUE'),
{_pairs('src')}, {numbered}, {_GREEDY}
SELECT article_id, CASE WHEN m.b IS NOT NULL THEN 'NEAR_DUPLICATE' ELSE duplicate_status END AS duplicate_status, coalesce(m.a, duplicate_of) AS duplicate_of FROM exact LEFT JOIN marks ON m.b = article_id""",
        "duplicate_preview": f"SELECT id, link, copies FROM (SELECT id, link, count(*) OVER (PARTITION BY link) AS copies FROM {RAW} WHERE link IS NOT NULL) WHERE copies > 1",
        "existing_hashes": "SELECT content_hash, min(article_id) AS first_article FROM processed_news WHERE content_hash IS NOT NULL GROUP BY content_hash",
        "same_day_articles": f"SELECT p.article_id, p.publication_date, r.link FROM {PROCESSED} p JOIN {RAW} r ON r.id = p.article_id WHERE p.publication_date IS NOT NULL AND p.duplicate_status <> 'EXACT_DUPLICATE'",
        "unprocessed_ids": f"SELECT r.id FROM {RAW} r LEFT JOIN {PROCESSED} p ON r.id = p.article_id WHERE p.article_id IS NULL OR p.processing_status = 'FAILED'",
        "needing_enrichment": f"SELECT article_id FROM {COMPLETED} WHERE article_id NOT IN (SELECT article_id FROM article_entities WHERE article_id IS NOT NULL)",
        "upsert_latest_wins": """WITH done AS (SELECT article_id, processing_status, processing_timestamp, CAST(NULL AS INTEGER) AS article_length_words FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY processing_timestamp DESC) AS r FROM processed_news WHERE processing_status = 'COMPLETED') WHERE r = 1),
old AS (SELECT article_id, processing_status, processing_timestamp, article_length_words FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY processing_timestamp DESC) AS r FROM processed_news WHERE processing_status <> 'COMPLETED') WHERE r = 1)
SELECT article_id, processing_status, rtrim(rtrim(strftime(processing_timestamp, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS at, article_length_words
FROM (SELECT * FROM old WHERE article_id NOT IN (SELECT article_id FROM done) UNION ALL SELECT * FROM done)""",
        "new_links": f"SELECT min(article_id) AS id, link FROM news_batches WHERE link IS NOT NULL AND link <> 'N/A' AND link NOT IN (SELECT link FROM {RAW} WHERE link IS NOT NULL) GROUP BY link",
        "stage_log": f"""WITH r AS (SELECT id AS article_id, {_REASON} AS reason, date, CASE WHEN ({_REASON}) = '' THEN {_date('date')} END AS p FROM {RAW}),
st AS (SELECT article_id, 1 AS step, 'VALIDATION' AS stage, CASE WHEN reason = '' THEN 'SUCCESS' ELSE 'FAILED' END AS status, reason AS message FROM r
UNION ALL SELECT article_id, 2, 'DATE_NORMALIZATION', CASE WHEN p IS NULL THEN 'FAILED' ELSE 'SUCCESS' END, CASE WHEN p IS NULL THEN 'raw=''' || coalesce(date, '') || '''' ELSE '' END FROM r WHERE reason = ''
UNION ALL SELECT article_id, 3, 'CLEANING', 'SUCCESS', '' FROM r WHERE reason = ''
UNION ALL SELECT article_id, 4, 'DEDUPLICATION', 'SUCCESS', 'UNIQUE' FROM r WHERE reason = '') SELECT * FROM st""",
        "sentiment_lexicon": f"SELECT article_id, {label} AS sentiment, round({score}, 6) AS sentiment_score, 'lexicon' AS sentiment_model FROM {COMPLETED}",
        "signed_sentiment_daily": f"""WITH s AS (SELECT publication_date, {label} AS l, {score} AS s FROM {COMPLETED} WHERE publication_date IS NOT NULL)
SELECT publication_date, count(*) AS articles, round(avg(CASE l WHEN 'positive' THEN s WHEN 'negative' THEN -s ELSE 0 END), 6) AS average FROM s GROUP BY publication_date""",
        "entities_pattern": f"WITH m AS ({entity_union}) SELECT article_id, trim(entity) AS entity, entity_type, CAST(count(*) AS DOUBLE) AS confidence FROM m WHERE trim(entity) <> '' GROUP BY ALL",
        "keywords_tfidf_topn": f"""WITH d AS (SELECT article_id, list_filter({_tokens('content_clean')}, lambda x: x NOT IN {_in(list(config.STOPWORDS))}) AS w FROM {COMPLETED}),
t AS (SELECT article_id, unnest(w) AS keyword FROM d UNION ALL SELECT article_id, w[i] || ' ' || w[i + 1] FROM (SELECT article_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d)),
tf AS (SELECT article_id, keyword, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT keyword, count(*) AS df FROM tf GROUP BY keyword),
s AS (SELECT article_id, keyword, tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS score FROM tf JOIN df USING (keyword))
SELECT article_id, keyword, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(score, 9) DESC, keyword) AS rank FROM s) WHERE rank <= 10""",
        "topic_assign_nearest_centroid": """WITH p AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY ALL),
n AS (SELECT p.vec_id, c.label AS topic_id, sum(p.x * c.x) / sqrt(sum(CAST(p.x AS DOUBLE) * p.x)) / sqrt(sum(c.x * c.x)) AS similarity FROM p JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, topic_id, round(similarity, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 9) DESC, topic_id) AS r FROM n) WHERE r = 1""",
        "topic_words_ctfidf": f"""WITH t AS (SELECT source AS topic_id, unnest({_tokens('text')}) AS word FROM documents WHERE source IS NOT NULL),
c AS (SELECT topic_id, word, count(*) AS tf FROM t GROUP BY ALL), s AS (SELECT topic_id, sum(tf) AS size FROM c GROUP BY topic_id), f AS (SELECT word, sum(tf) AS f FROM c GROUP BY word),
x AS (SELECT topic_id, word, round(tf / size * ln(1 + (SELECT avg(size) FROM s) / f), 9) AS score FROM c JOIN s USING (topic_id) JOIN f USING (word))
SELECT topic_id, word, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, word) AS rank FROM x) WHERE rank <= 10""",
        "topic_rename": "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS topic_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'First of all' WHEN '3' THEN 'In between' ELSE o_orderpriority END AS topic_name FROM orders",
        "binary_metrics": f"WITH s AS (SELECT series AS k, label_pre_crisis AS label, anomaly_score / (anomaly_score + 2) AS score FROM {WEEKLY} WHERE label_pre_crisis IS NOT NULL AND anomaly_score / (anomaly_score + 2) >= 0), {areas} SELECT k AS series, tn, fp, fn, tp, {_round('precision', 'recall', 'f1', 'roc_auc', 'pr_auc')} FROM b",
        "fold_averages": f"WITH s AS (SELECT crisis_event AS k, label_pre_crisis AS label, anomaly_score / (anomaly_score + 2) AS score FROM {WEEKLY} WHERE crisis_event IS NOT NULL AND label_pre_crisis IS NOT NULL AND anomaly_score / (anomaly_score + 2) >= 0), {areas} SELECT 'anomaly' AS model, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(roc_auc), 6) AS roc_auc, round(avg(pr_auc), 6) AS pr_auc FROM b",
        "multiclass_metrics": f"""WITH g AS (SELECT {truth} AS truth, {label} AS guess FROM {COMPLETED}), {classes}
SELECT label, {_round('precision', 'recall', 'f1')}, support FROM y
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM y
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM y
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM y""",
        "confusion_matrix": f"WITH g AS (SELECT {truth} AS truth, {label} AS guess FROM {COMPLETED}) SELECT truth, count(*) FILTER (guess = 'negative') AS negative, count(*) FILTER (guess = 'neutral') AS neutral, count(*) FILTER (guess = 'positive') AS positive FROM g GROUP BY truth",
        "lead_time": f"""WITH w AS (SELECT crisis_event, min(week) AS first_week FROM {WEEKLY} WHERE label_pre_crisis = 1 AND anomaly_score / (anomaly_score + 2) >= 0.5 GROUP BY crisis_event)
SELECT e.event_id, e.event_name, first_week AS first_detection_week, CAST(date_diff('day', CAST({_MONDAY.format('first_week')} AS DATE), e.start_date) AS INTEGER) AS lead_time_days FROM crisis_events e LEFT JOIN w ON w.crisis_event = e.event_id""",
        "sentiment_pivot_ratio": f"WITH {_ARTICLES} SELECT week AS publication_week, " + ", ".join(f"round(count(*) FILTER (sentiment = '{v}') / count(*), 6) AS {v}" for v in ("negative", "neutral", "positive")) + " FROM articles GROUP BY week",
        "topic_share": f"WITH {_ARTICLES} SELECT topic_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM articles GROUP BY topic_name",
        "top_keywords_scored": f"WITH {_ARTICLES} SELECT p_name AS keyword, count(*) AS n, round(avg(score), 6) AS average FROM lineitem JOIN articles ON l_orderkey = article_id JOIN part ON p_partkey = l_partkey GROUP BY p_name ORDER BY n DESC, keyword LIMIT 25",
        "date_pattern_counts": f"SELECT {pattern} AS pattern, count(*) AS n FROM {RAW} GROUP BY 1",
        "date_format_exceptions": f"SELECT id, date FROM {RAW} WHERE NOT coalesce(regexp_matches(date, '^[0-9]{{2}} [A-Za-z]{{3}} [0-9]{{4}}$'), false)",
        "weekday_counts": f"SELECT dayname(publication_date) AS weekday, CAST(isodow(publication_date) AS INTEGER) AS place, count(*) AS n FROM {COMPLETED} WHERE publication_date IS NOT NULL GROUP BY ALL",
        "weeks_with_fewest": f"SELECT CAST(date_trunc('week', publication_date) AS DATE) AS week_start, count(*) AS n FROM {COMPLETED} WHERE publication_date IS NOT NULL GROUP BY 1 ORDER BY n, week_start LIMIT 10",
        "null_empty_checks": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (trim({c}) = '') AS empties FROM scraped_news" for c in ("title", "content", "date", "link")),
        "length_stats": "SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS deviation, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS lower_quartile, median(n_chars) AS median, quantile_cont(n_chars, 0.75) AS upper_quartile, max(n_chars) AS greatest FROM documents",
        "length_histogram": "WITH s AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT CAST(coalesce(least(49, floor((n_chars - lo) / (hi - lo) * 50)), 0) AS INTEGER) AS bin, count(*) AS n FROM documents, s WHERE n_chars IS NOT NULL GROUP BY 1",
        "date_span": f"SELECT min(publication_date) AS first, max(publication_date) AS last, CAST(date_diff('day', min(publication_date), max(publication_date)) AS INTEGER) AS days, count(DISTINCT publication_date) AS different FROM {COMPLETED}",
        "examples_per_source": "SELECT source, doc_id, n_chars, CAST(place AS INTEGER) AS place FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 3",
        "fold_label_counts": f"SELECT crisis_event, label_pre_crisis, count(*) AS n FROM {WEEKLY} GROUP BY ALL",
        "sample_for_labelling": f"SELECT article_id FROM {COMPLETED} ORDER BY sha256(article_id || ':42') LIMIT 120",
        "raw_lookup": "SELECT DISTINCT id, title, date, link FROM scraped_news WHERE id IN (7, 41, 3, -1)",
        "panel_scan": f"SELECT series, week, article_count, crisis_event, label_pre_crisis FROM {WEEKLY}",
        "events_scan": "SELECT event_id, event_name, start_date, end_date FROM crisis_events",
        "topic_corpus": f"""SELECT article_id, regexp_replace(regexp_replace(coalesce(title_clean, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') || ' ' || regexp_replace(coalesce(content_clean, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text FROM {COMPLETED}""",
        "ml_weeks": f"SELECT series, week, label_pre_crisis, {', '.join(config.FEATURES)} FROM {WEEKLY} WHERE label_pre_crisis IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in config.FEATURES)}",
        "entity_dataset": f"SELECT e.article_id, e.entity_type, p.publication_week FROM (SELECT DISTINCT * FROM article_entities) e JOIN {PROCESSED} p ON p.article_id = e.article_id WHERE {population}",
        "entity_weeks": "SELECT p.publication_week AS week, " + ", ".join(f"CAST(count(*) FILTER (e.entity_type = '{t}') AS INTEGER) AS {c}" for c, t in config.ENTITY_GROUPS.items()) + f" FROM (SELECT DISTINCT * FROM article_entities) e JOIN {PROCESSED} p ON p.article_id = e.article_id WHERE {population} GROUP BY 1",
        "sentiment_by_topic": f"WITH {_ARTICLES} SELECT topic_name, " + ", ".join(f"count(*) FILTER (sentiment = '{v}') AS {v}" for v in ("negative", "neutral", "positive")) + ", round(avg(CASE sentiment WHEN 'positive' THEN score WHEN 'negative' THEN -score ELSE 0 END), 6) AS average FROM articles GROUP BY topic_name",
        "weekly_event_windows": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    }
    return out
