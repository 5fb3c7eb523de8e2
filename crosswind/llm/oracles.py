"""DuckDB SQL for the text queries that SQL can express, written apart from the operators."""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, contains(role || ' ' || text, '###') OR contains(role || ' ' || text, '</turn>') OR contains(role, ': ') OR suffix(role, ':') AS odd,
    replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), ': ', ':\ ') AS x,
    replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), ': ', ':\ ') AS r
  FROM turns
), sized AS (
  SELECT *, CASE WHEN odd THEN length(replace(replace(r, '###', '#\##'), '###', '#\##')) + length(replace(replace(x, '###', '#\##'), '###', '#\##')) + 15
    ELSE length(role) + length(text) + 14 END AS chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), f AS (
  SELECT *, translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS solid,
    list_filter(string_split(text, chr(10)), lambda l: translate(l, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS lines
  FROM d
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM f, range(1, len(words) - 1) AS r(i)
), hits AS (
  SELECT DISTINCT doc_id, i + k AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams), range(0, 3) AS s(k) WHERE c > 1
), reps AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id),
l AS (
  SELECT doc_id, line, translate(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '') AS s,
    list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, unnest(lines) AS line FROM f)
), m AS (
  SELECT *, len(w) AS n, length(s) AS c, length(regexp_replace(s, '[^A-Z]', '', 'g')) AS up,
    length(regexp_replace(s, '[^|»·]', '', 'g')) AS bars, length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) AS sym, length(regexp_replace(s, '[^!]', '', 'g')) AS sh
  FROM l
), bad AS (
  SELECT doc_id, sum(c) AS lost FROM m
  WHERE (bars >= 2 AND bars * 5 >= n) OR (sym >= 3 AND sym * 10 >= c) OR (sh >= 3 AND sh * 3 >= n) OR (n >= 4 AND regexp_matches(line, '[A-Z][A-Z]') AND up * 2 > c)
    OR (n >= 10 AND len(list_distinct(w)) * 3 <= n)
    OR (n <= 40 AND regexp_matches(lower(line), 'all rights reserved|licensed under|spdx-license-identifier|terms of use|privacy policy|cookie policy|enable javascript|lorem ipsum|click here|subscribe to our newsletter'))
    OR (n < 6 AND NOT contains('.!?…:;"''”’»)]', right(s, 1)))
  GROUP BY doc_id
), t AS (
  SELECT f.doc_id, len(words)::BIGINT AS n_words, length(solid)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words, coalesce(bad.lost, 0) AS lost
  FROM f LEFT JOIN reps USING (doc_id) LEFT JOIN bad USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars = 0 THEN 100 ELSE floor(100.0 * lost / word_chars) END::BIGINT AS lost_percent FROM t
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_percent <= 50 AS kept, lost_percent FROM v
"""

HITS_SQL = r"""
WITH low AS (
  SELECT 'd' AS k, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT k, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low
), items AS (
  SELECT DISTINCT id AS item, least(10, len(ws)) AS n, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS win
  FROM w, range(1, greatest(2, len(ws) - 8)) AS r(p) WHERE k = 'i' AND len(ws) > 0
), lens AS (SELECT DISTINCT n FROM items),
wins AS (
  SELECT id, p, n, array_to_string(ws[p : p + n - 1], ' ') AS win FROM w, lens, range(1, len(ws) - n + 2) AS r(p) WHERE k = 'd'
), hit AS (SELECT id, p, n, win FROM wins WHERE win IN (SELECT win FROM items)),
pos AS (SELECT id, count(DISTINCT p + o) AS n_hit FROM hit, range(0, 10) AS s(o) WHERE o < n GROUP BY id),
its AS (
  SELECT id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item::VARCHAR))), ',') AS items FROM hit JOIN items USING (win, n) GROUP BY id
)
SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (id) LEFT JOIN its USING (id) WHERE k = 'd'
"""

LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE t <> ''),
d AS (SELECT doc_id, list(t ORDER BY i) AS ts, count(*) AS n FROM f GROUP BY doc_id),
w AS (SELECT doc_id, s, least(n, 3) AS k, array_to_string(ts[s + 1 : s + 3], chr(10)) AS win FROM d, range(0, greatest(n - 2, 1)) AS r(s)),
later AS (SELECT doc_id, s, k FROM w QUALIFY row_number() OVER (PARTITION BY win, k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM later, range(0, 3) AS x(o) WHERE o < k),
g AS (SELECT f.doc_id, f.i FROM f JOIN gone USING (doc_id, p)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = l.doc_id AND g.i = l.i) GROUP BY doc_id)
SELECT x.doc_id, CASE WHEN x.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(d.n, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed
FROM documents x LEFT JOIN kept USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) c USING (doc_id)
"""
