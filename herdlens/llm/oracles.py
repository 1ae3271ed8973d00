"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH cut AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, w[b + 1 : b + 10] AS win, len(w[b + 1 : b + 10]) AS size
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS b FROM cut WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT size FROM windows
), grams AS (
  SELECT r, size, b, w[b + 1 : b + size] AS win
  FROM (SELECT r, w, size, unnest(range(0, len(w) - size + 1)) AS b FROM docs, sizes WHERE len(w) >= size)
), hits AS (
  SELECT g.r, g.b, g.size, x.item FROM grams g JOIN windows x ON g.size = x.size AND g.win = x.win
), words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(b, b + size)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP7 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') || ': '
      || replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') || '</turn>' || chr(10))) AS chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM told
"""

OP6 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines,
    md5(concat_ws(chr(10), coalesce(CAST(doc_id AS VARCHAR), 'null'), text)) AS digest FROM documents
), windows AS (
  SELECT r, doc_id, digest, i, array_to_string(lines[i + 1 : i + 3], chr(10)) AS win
  FROM (SELECT r, doc_id, digest, lines, unnest(range(0, len(lines) - 2)) AS i FROM docs WHERE len(lines) >= 3)
), ranked AS (
  SELECT r, i, rank() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, digest, i) AS place FROM windows
), gone AS (
  SELECT r, p, count(*) AS c FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM ranked WHERE place > 1) GROUP BY r, p
), each AS (
  SELECT r, unnest(range(0, len(lines))) AS p, unnest(lines) AS line FROM docs
), kept AS (
  SELECT e.r, count(g.c) AS n_deleted, string_agg(e.line, chr(10) ORDER BY e.p) FILTER (g.c IS NULL) AS rest
  FROM each e LEFT JOIN gone g ON e.r = g.r AND e.p = g.p GROUP BY e.r
)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
  CASE WHEN text IS NOT NULL THEN coalesce(rest, '') END AS text
FROM docs LEFT JOIN kept USING (r)
"""

ALL = {"op6_line_dedup": OP6, "op7_chat": OP7, "op4_decontamination": OP4}
