"""The queries in SQL, for those that SQL can express within reason."""

from __future__ import annotations

from trackforge.llm.url_filter import BLOCKED_WEIGHT, WEIGHTS

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
s AS (SELECT doc_id, i, n, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS win FROM u),
r AS (SELECT doc_id, i, word, i <= n - 34 AND count(*) FILTER (i <= n - 34) OVER (PARTITION BY win) > 1 AS again FROM s),
g AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 90 * (x.n + y.n - c.c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""


LOWER_URL = LOWER.replace("text", "url")


def _hits(value: str, chosen: str) -> str:
    """Sum of value over the distinct terms found in the url whose weight w is chosen."""
    listed = ", ".join(f"{{'t': '{t}', 'w': {w}}}" for t, w in WEIGHTS.items())
    return f"CAST(coalesce(list_sum(list_transform(list_filter([{listed}], lambda x: {chosen} AND regexp_matches({LOWER_URL}, '(^|[^a-z0-9])' || x.t || '([^a-z0-9]|$)')), lambda x: {value})), 0) AS INT)"


def _fits(host: str) -> str:
    return f"(host = '{host}' OR suffix(host, '.{host}'))"


URL_FILTER = rf"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
q AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE WHEN {_fits("example.org")} AND prefix(path, '/en/1') THEN 'example.org/en/1' WHEN {_fits("example.org")} AND prefix(path, '/es/') THEN 'example.org/es/'
  WHEN {_fits("com")} AND prefix(path, '/fr/') THEN 'com/fr/' WHEN {_fits("com")} AND prefix(path, '/de/') THEN 'com/de/' WHEN {_fits("org")} AND prefix(path, '/') THEN 'org/' END AS rule,
  {_hits("1", f"x.w >= {BLOCKED_WEIGHT}")} AS strict_terms, {_hits("1", f"x.w < {BLOCKED_WEIGHT}")} AS soft_terms, {_hits("x.w", "true")} AS weight FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/fr/', 'org/') THEN 'allow' WHEN rule IS NOT NULL OR weight >= {BLOCKED_WEIGHT} THEN 'block' ELSE 'allow' END AS verdict, strict_terms, soft_terms, weight FROM r
"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS r2,
  t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 AS plain, CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 AS spm FROM d),
c AS (SELECT *, array_to_string(w[1:least(r1, r2)], '') AS prefix, array_to_string(w[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle, array_to_string(w[greatest(r1, r2) + 1:], '') AS suffix FROM r)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""

TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

LEXICAL_SEARCH = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, {TERMS})) AS t FROM documents),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, {TERMS})) AS t FROM benchmark) GROUP BY item_id, t),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t, docs),
m AS (SELECT doc_id, 75 + (25 * n * docs) // length AS m FROM n, c),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
