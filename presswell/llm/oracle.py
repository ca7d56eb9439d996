"""SQL twins of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

_COMPLETED = """
WITH cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY processing_timestamp DESC NULLS LAST) AS r FROM processed_news)
  WHERE r = 1 AND processing_status = 'COMPLETED')
"""

_SCRAPED = """
WITH cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC NULLS LAST) AS r FROM scraped_news WHERE id IS NOT NULL)
  WHERE r = 1)
"""

_RUNS = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
k AS (SELECT item_id, w, least(12, len(w)) AS size FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS run FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS p FROM k)),
sizes AS (SELECT DISTINCT size FROM k),
dw AS (SELECT DISTINCT doc_id, size, array_to_string(w[p:p + size - 1], ' ') AS run
       FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d, sizes WHERE len(w) >= size))
"""

_WORDS = "regexp_extract_all(lower(coalesce(content_clean, '')), '[\\p{L}\\p{N}]+')"

#: Every pair of texts (n numbers a text) that shares a sequence of three words, with its similarity.
_SIMILAR = """
w AS (SELECT n, {words} AS w FROM texts),
s AS (SELECT DISTINCT n, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT n, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
size AS (SELECT n, count(*) AS size FROM s GROUP BY n),
met AS (SELECT x.n AS x, y.n AS y, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.n < y.n GROUP BY ALL),
near AS (SELECT x, y FROM met JOIN size p ON p.n = x JOIN size q ON q.n = y WHERE shared >= 0.6 * (p.size + q.size - shared) - 1e-9)
""".replace("{words}", _WORDS)


def _repeated(source: str, key: str) -> str:
    """The places of lines that recur within a site, of ``source`` (key, site, content)."""
    return f"""t AS (SELECT site, count(*) AS docs FROM {source} WHERE site IS NOT NULL GROUP BY site),
p AS (SELECT {key}, site, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no
      FROM {source} WHERE site IS NOT NULL AND content IS NOT NULL),
n AS (SELECT {key}, site, CAST(line_no AS INTEGER) AS line_no,
        regexp_replace(trim(regexp_replace(lower(line), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '[0-9]+', '0', 'g') AS k FROM p),
f AS (SELECT site, k, count(DISTINCT {key}) AS df FROM n WHERE k <> '' GROUP BY site, k),
gone AS (SELECT DISTINCT {key}, line_no FROM n JOIN f USING (site, k) JOIN t USING (site) WHERE df >= 5 AND df >= round(0.03 * docs, 9))"""


_SITE = "nullif(regexp_replace(lower(regexp_extract(link, '^\\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\\s]+)', 1)), '^(www|m)\\.', ''), '')"
_SITED = _SCRAPED + f", d AS (SELECT id, {_SITE} AS site, content FROM cur), " + _repeated("d", "id")

ORACLE: dict[str, str] = {
    "p2_found": _COMPLETED
    + """, every AS (SELECT article_id, content_clean, false AS fresh FROM cur UNION ALL SELECT DISTINCT article_id, content_clean, true FROM news_batches WHERE article_id IS NOT NULL),
texts AS (SELECT *, row_number() OVER () AS n FROM every), """
    + _SIMILAR
    + """, sides AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near)
SELECT DISTINCT a.article_id AS id_a, b.article_id AS id_b FROM sides JOIN texts a ON a.n = x JOIN texts b ON b.n = y WHERE b.fresh AND a.article_id < b.article_id""",
    "p3_found": _COMPLETED.replace("WITH cur", "WITH RECURSIVE cur")
    + ", texts AS (SELECT article_id AS n, content_clean FROM cur), "
    + _SIMILAR
    + """, e AS (SELECT x AS a, y AS b FROM near UNION SELECT y, x FROM near),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT least(a, min(b)) AS group_id, a AS article_id FROM reach GROUP BY a HAVING least(a, min(b)) < a""",
    "p5_cleaned": _SITED
    + """, kept AS (SELECT id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM (SELECT id, line, CAST(line_no AS INTEGER) AS line_no FROM p) q WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = q.id AND gone.line_no = q.line_no) GROUP BY id)
SELECT d.id, CASE WHEN d.id IN (SELECT id FROM gone) THEN coalesce(kept.text, '') ELSE d.content END AS text FROM d LEFT JOIN kept USING (id)""",
    "p5_remains": _COMPLETED
    + f""", raw AS (SELECT id, link FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC NULLS LAST) AS r FROM scraped_news WHERE id IS NOT NULL) WHERE r = 1),
d AS (SELECT cur.article_id, {_SITE} AS site, content_clean AS content FROM cur LEFT JOIN raw ON raw.id = cur.article_id), """
    + _repeated("d", "article_id")
    + " SELECT article_id, line_no FROM gone",
    "p8_items": _RUNS
    + """, found AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (size, run)),
runs AS (SELECT f.item_id, max(z) AS longest_run FROM (SELECT doc_id, item_id, unnest(generate_series(1, 400)) AS z FROM found) f JOIN d USING (doc_id) JOIN i USING (item_id)
  WHERE z <= len(i.w) AND len(list_filter(generate_series(1, len(i.w) - z + 1), lambda p: contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w[p:p + z - 1], ' ') || ' '))) > 0 GROUP BY f.item_id)
SELECT item_id, count(*) AS documents, CAST(any_value(longest_run) AS INTEGER) AS longest_run FROM found JOIN runs USING (item_id) GROUP BY item_id""",
    "p6_counts": _COMPLETED
    + """, t AS (SELECT *, list_filter(regexp_split_to_array(coalesce(content_clean, ''), '[ \\n\\r\\t]+'), lambda x: x <> '') AS t FROM cur)
SELECT article_id, CAST(len(t) AS INTEGER) AS words, CAST(length(coalesce(content_clean, '')) AS INTEGER) AS chars,
  CAST((SELECT count(*) FROM unnest(t.t) AS u(x) WHERE lower(x) IN (SELECT lower(word) FROM common_words)) AS INTEGER) AS common_words,
  article_length_words, sentence_count, article_length_words <> len(t) AS words_differ
FROM t
""",
    "p6_duplicates": _COMPLETED
    + """, t AS (SELECT article_id, coalesce(content_clean, '') AS t FROM cur),
l AS (SELECT article_id, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '') AS w,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '') AS l,
  list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM t)
SELECT article_id, CAST(len(w) AS INTEGER) AS words, CASE WHEN len(l) = 0 THEN 0.0 ELSE round(1 - len(list_distinct(l)) / len(l), 6) END AS duplicate_lines,
  CASE WHEN len(p) = 0 THEN 0.0 ELSE round(1 - len(list_distinct(p)) / len(p), 6) END AS duplicate_paragraphs FROM l""",
    "p10_prefixes": "SELECT DISTINCT d.doc_id FROM documents d JOIN documents e ON d.text <> '' AND length(e.text) > length(d.text) AND starts_with(e.text, d.text)",
    "p8_found": _RUNS + "SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (size, run)",
    "p5_found": _SITED + " SELECT id, line_no FROM gone",
    "p9_found": """
WITH s AS (SELECT source, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> ''))) AS BIGINT) AS size FROM documents GROUP BY source)
SELECT DISTINCT m.source FROM mix_targets m LEFT JOIN s USING (source)
WHERE m.source IS NOT NULL AND coalesce(s.size, 0) * m.max_repeats < m.target_share * (SELECT sum(size) FROM s)
""",
    "p9_check": "SELECT DISTINCT source, true AS share_met, true AS repeats_kept, true AS as_planned FROM mix_targets WHERE source IS NOT NULL",
    "p9_sizes": """
SELECT source, count(*) AS documents, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> ''))) AS BIGINT) AS size
FROM documents GROUP BY source
""",
}
