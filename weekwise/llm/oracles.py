"""SQL (DuckDB dialect) for the queries that SQL can express."""

from __future__ import annotations

BLANK = r"\x20\x09-\x0D"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
h AS (SELECT doc_id, j, CASE WHEN j + 49 <= len(w) THEN md5(array_to_string(w[j : j + 49], ' ')) END AS k, w[j] AS word FROM p),
f AS (SELECT k, min(doc_id) AS first FROM h WHERE k IS NOT NULL GROUP BY k),
m AS (SELECT doc_id, j, word, coalesce(first < doc_id, false) AS late FROM h LEFT JOIN f ON h.k = f.k),
c AS (SELECT doc_id, j, word, bool_or(late) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
s AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{BLANK}]')) AS lines FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS j FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, j, count(*) OVER (PARTITION BY doc_id, w[j], w[j + 1], w[j + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT j + o) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY doc_id),
o AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, coalesce(most, 0) AS most,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS bare,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[{BLANK}]*[-*•·]'))) AS bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[{BLANK}]*$'))) AS ellipses
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN o ON d.doc_id = o.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
    OR 5 * bare > n_words OR 10 * bullets > 9 * n_lines OR 10 * ellipses > 3 * n_lines OR 10 * most > 3 * n_words) AS kept FROM v"""

_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[j : j + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
h AS (SELECT doc_id, j, k.n, item FROM (SELECT p.*, l.n FROM p, (SELECT DISTINCT n FROM k) l WHERE j + l.n - 1 <= len(w)) q
  JOIN k ON k.n = q.n AND k.win = array_to_string(q.w[j : j + q.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS x FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""

WARC = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
lead AS (SELECT payload_digest, max(page_id) AS leader FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, payload_bytes, p.payload_digest, CASE WHEN page_id < leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < leader THEN leader END AS refers_to
FROM p LEFT JOIN lead USING (payload_digest)"""


DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(c) AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.total, 0) + 2 * v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.c + 2)) // (v.total + 2 * v.v)::HUGEINT AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN n ON g.lang = n.lang AND g.source = n.source
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
