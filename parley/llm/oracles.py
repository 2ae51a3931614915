"""DuckDB SQL for the rows of operators that SQL can express over whole tables."""

from __future__ import annotations

from parley.llm import decontaminate, jaccard, language_model, substrings

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"

JACCARD = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", _WORD)} AS ws FROM documents),
starts AS (SELECT r, ws, unnest(range(1, greatest(len(ws) - {jaccard.SHINGLE - 1}, 1) + 1)) AS i FROM docs WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT r, array_to_string(ws[i:i + {jaccard.SHINGLE - 1}], ' ') AS s FROM starts),
sets AS (SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS node FROM shingles GROUP BY r),
classes AS (SELECT node, min(r) AS first, any_value(n) AS n, count(*) AS copies, min(doc_id) AS id FROM sets JOIN docs USING (r) GROUP BY node),
held AS (SELECT node, n, s FROM classes JOIN shingles ON r = first),
shared AS (SELECT a.node AS a, b.node AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS total FROM held a JOIN held b ON a.s = b.s AND a.node <> b.node GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= {jaccard.PERCENT} * (total - c)),
reach AS (SELECT node AS a, node AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS node, min(id) AS component_id FROM reach JOIN classes ON b = node GROUP BY a),
partners AS (SELECT a AS node, sum(copies) AS other FROM links JOIN classes ON b = node GROUP BY a)
SELECT doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  CAST(coalesce(other, 0) + coalesce(copies - 1, 0) AS BIGINT) AS n_links
FROM docs LEFT JOIN sets s USING (r) LEFT JOIN classes k ON k.node = s.node LEFT JOIN component m ON m.node = s.node LEFT JOIN partners p ON p.node = s.node
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", _TERM)} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", _TERM)} AS ws FROM benchmark),
sized AS (SELECT item, ws, least(len(ws), {decontaminate.WINDOW}) AS k, unnest(range(1, len(ws) - least(len(ws), {decontaminate.WINDOW}) + 2)) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM sized),
tried AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(ws) >= k),
found AS (SELECT r, i, t.k, item FROM tried t JOIN windows v ON v.k = t.k AND v.w = array_to_string(ws[i:i + t.k - 1], ' ')),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

BACKOFF = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", _WORD)} AS ws FROM documents),
places AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs),
grams AS (SELECT r, i, n, array_to_string(ws[i - n + 1:i], ' ') AS g FROM places, range(1, {language_model.ORDER + 1}) t(n) WHERE i >= n),
own AS (SELECT r, n, g, count(*) AS c FROM grams GROUP BY ALL),
every AS (SELECT n, g, sum(c) AS c FROM own GROUP BY ALL),
rest AS (SELECT r, n, g, e.c - o.c AS c FROM own o JOIN every e USING (n, g)),
counted AS (SELECT p.r, p.i, p.n, c FROM grams p JOIN rest USING (r, n, g)),
met AS (SELECT w.r, w.i, w.n, w.c, h.c AS history FROM counted w LEFT JOIN counted h ON h.r = w.r AND h.i = w.i - 1 AND h.n = w.n - 1),
best AS (SELECT r, i, max(n) AS available, max(n) FILTER (WHERE c > 0 OR n = 1) AS used FROM met GROUP BY ALL),
words AS (SELECT sum(len(ws)) AS total FROM docs),
logs AS (
  SELECT b.r, available - used AS down, (available - used) * ln({language_model.BACKOFF})
    + CASE WHEN used = 1 THEN ln(greatest(c, {language_model.UNSEEN}) / greatest(total - len(ws), 1)) ELSE ln(c / history) END AS l
  FROM best b JOIN met m ON m.r = b.r AND m.i = b.i AND m.n = b.used JOIN docs d ON d.r = b.r, words),
sums AS (SELECT r, sum(down) AS n_backoffs, sum(l) AS score FROM logs GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_backoffs, 0) AS BIGINT) AS n_backoffs, round(coalesce(score, 0.0), 4) AS score,
  round(coalesce(score / len(ws), 0.0), 6) AS mean_score
FROM docs LEFT JOIN sums USING (r)
"""

SUBSTRINGS = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
tiles AS (SELECT r, id, len(h) // 2 AS n, p, substr(h, 2 * p + 1, 2 * {256 + substrings.LENGTH - 1}) AS t FROM (SELECT *, unnest(range(0, len(h) // 2, 256)) AS p FROM docs)),
places AS (SELECT r, id, p, t, unnest(range(0, least(256, n - p - {substrings.LENGTH - 1}))) AS j FROM tiles),
windows AS (SELECT r, id, p + j AS i, substr(t, 2 * j + 1, {2 * substrings.LENGTH}) AS w FROM places),
firsts AS (SELECT w, min(id) AS first FROM windows GROUP BY w HAVING count(*) > 1 AND min(id) < max(id)),
gone AS (SELECT r, i, i > lag(i, 1, -{substrings.LENGTH} - 1) OVER (PARTITION BY r ORDER BY i) + {substrings.LENGTH} AS new FROM windows JOIN firsts USING (w) WHERE first < id),
numbered AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM gone),
runs AS (SELECT r, min(i) AS a, max(i) + {substrings.LENGTH} AS b FROM numbered GROUP BY r, run),
cuts AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM runs),
kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM cuts JOIN docs USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
