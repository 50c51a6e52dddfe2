"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

OP11 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) "
    "SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, "
    "doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM d WINDOW g AS (PARTITION BY t)"
)

# Forward DP of the least (cost, audit) for every state, a row of each conversation at a time.
# ways: from a state, before a row, k inserts and the lines they write.  States: n none, s, u, a.
OP13 = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS step, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE step = 8),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(
      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
      lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS hit
  FROM conversations, tab),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE hit <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char FROM rows_),
faulty AS (
  SELECT *, CASE WHEN last_char = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM numbered),
ways(p, k, q, lines, letters) AS (VALUES
  ('n', 0, 'n', '', ''), ('n', 1, 'u', E'\nuser:', 'I'), ('n', 2, 'a', E'\nuser:\nassistant:', 'II'),
  ('s', 0, 's', '', ''), ('s', 1, 'u', E'\nuser:', 'I'), ('s', 2, 'a', E'\nuser:\nassistant:', 'II'),
  ('u', 0, 'u', '', ''), ('u', 1, 'a', E'\nassistant:', 'I'), ('a', 0, 'a', '', ''), ('a', 1, 'u', E'\nuser:', 'I')),
step AS (
  SELECT conv_id, 0::BIGINT AS i, 'n' AS p, {'c': 0::BIGINT, 'a': '', 'o': ''} AS best
  FROM (SELECT DISTINCT conv_id FROM faulty)
  UNION ALL
  SELECT conv_id, i, q, min(best) FROM (
    SELECT s.conv_id, f.i, e.q, {'c': s.best.c + 3 * w.k + e.cost, 'a': s.best.a || w.letters || e.letter,
      'o': s.best.o || w.lines || e.line} AS best
    FROM step s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
    JOIN ways w ON w.p = s.p,
    LATERAL (
      SELECT w.q AS q, 4 AS cost, 'D' AS letter, '' AS line
      UNION ALL
      SELECT CASE WHEN left(f.role, 1) = 's' THEN 's' WHEN left(f.role, 1) = 'u' THEN 'u' ELSE 'a' END,
        CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END, 'K', E'\n' || f.role || ':' || f.text
      WHERE f.fault IN ('fine', 'truncated') AND (w.q || left(f.role, 1)) IN ('ns', 'nu', 'su', 'au', 'ua')
      UNION ALL
      SELECT CASE WHEN w.q = 'u' THEN 'a' ELSE 'u' END, CASE WHEN f.fault = 'truncated' THEN 6 ELSE 3 END, 'R',
        CASE WHEN w.q = 'u' THEN E'\nassistant:' ELSE E'\nuser:' END || f.text
      WHERE f.fault IN ('fine', 'truncated')) e
  ) GROUP BY conv_id, i, q),
ended AS (
  SELECT s.conv_id, min({'c': best.c + CASE p WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END,
    'a': best.a || CASE p WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
    'o': best.o || CASE p WHEN 's' THEN E'\nuser:\nassistant:' WHEN 'u' THEN E'\nassistant:' ELSE '' END}) AS best
  FROM step s JOIN (SELECT conv_id, max(i) AS i FROM faulty GROUP BY conv_id) n
    ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.i = s.i GROUP BY s.conv_id),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank,
  coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
  coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost, coalesce(e.best.a, '') AS audit,
  sha256(coalesce(e.best.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_TERMS = (r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term")
OP12 = (
    "WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents), "
    f"t AS (SELECT doc_id, r, {_TERMS} FROM d), "
    "c AS (SELECT doc_id, r, term, count(*) AS tf FROM t GROUP BY doc_id, r, term), "
    "size_ AS (SELECT r, sum(tf)::BIGINT AS terms FROM c GROUP BY r), "
    "total AS (SELECT count(*)::BIGINT AS docs, sum(terms)::BIGINT AS all_terms FROM size_), "
    "freq AS (SELECT term, count(*) AS df FROM c GROUP BY term), "
    "b AS (SELECT item_id, text, row_number() OVER () AS q FROM benchmark), "
    f"i AS (SELECT item_id, q, {_TERMS} FROM b), "
    "s AS (SELECT item_id, q, doc_id, r, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * "
    "((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * terms * docs) // all_terms))))::BIGINT AS score "
    "FROM i JOIN c USING (term) JOIN freq USING (term) JOIN size_ USING (r), total GROUP BY item_id, q, doc_id, r) "
    "SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s "
    "WHERE score > 0 QUALIFY rank <= 20"
)

ORACLE: dict[str, str] = {
    "op11_golomb_dedup": OP11,
    "op12_lexical_search": OP12,
    "op13_conversation_repair": OP13,
}
