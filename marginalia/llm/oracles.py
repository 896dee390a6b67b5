"""SQL for the operators on conversations."""

DIALOGUE: dict[str, str] = {}

DIALOGUE["op11_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM turns),
escaped AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS e_role,
         regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS e_text FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(e_role) + length(e_text) + 17))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


DIALOGUE["op12_prefix_trie"] = r"""
WITH RECURSIVE bytes AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS rest
  FROM (SELECT unnest(range(256)) AS b)),
remainders AS (SELECT list(rest ORDER BY b) AS rests FROM bytes),
ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS source,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, x: xor(c >> 8, rests[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS head
  FROM conversations, remainders WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT p.conv_id, place, role, text FROM placed p JOIN ids USING (conv_id) WHERE place > head
  UNION ALL
  SELECT ids.conv_id, place, role, text FROM ids JOIN placed p ON p.conv_id = ids.source WHERE place <= head),
numbered AS (
  SELECT conv_id, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(sha256(role || chr(0) || text), '') OVER w AS path,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
members AS (
  SELECT conv_id, depth, path, left(path, (length(path) - 64)::BIGINT) AS above, words, depth = n AS ends FROM numbered
  UNION ALL
  SELECT conv_id, 0, '', NULL, 0, NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = ids.conv_id) FROM ids),
nodes AS (
  SELECT path, any_value(above) AS above, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY path),
children AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
sums AS (
  SELECT u.path, count(*) FILTER (WHERE c.path IS NULL) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM nodes u JOIN nodes v ON starts_with(v.path, u.path) LEFT JOIN children c ON c.path = v.path GROUP BY u.path)
SELECT u.conv_id, u.depth, p.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, u.ends_sha256
FROM nodes u LEFT JOIN nodes p ON p.path = u.above LEFT JOIN children c ON c.path = u.path JOIN sums s ON s.path = u.path
"""

DIALOGUE["op13_structure_repair"] = r"""
WITH RECURSIVE bytes AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS rest
  FROM (SELECT unnest(range(256)) AS b)),
remainders AS (SELECT list(rest ORDER BY b) AS rests FROM bytes),
fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                                                       lambda x: ascii(x)::BIGINT)),
                         lambda c, x: xor(c >> 8, rests[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations, remainders),
turns AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0),
copies AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final, left(role, 1) AS initial FROM turns),
placed AS (
  SELECT *, row_number() OVER w AS place, lag(initial) OVER w AS before, lag(turn) OVER w AS turn_before,
         CASE WHEN final = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM copies WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth)),
inserts(st, k, mid) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)),
keeps(initial, mid, st_next) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
reroles(mid, st_next) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
signed AS (SELECT conv_id, place, initial, fault IN ('blank', 'duplicate') AS forced, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra FROM placed),
steps AS (
  SELECT s.conv_id, place, st, mid AS st_next, 3 * k + 4 AS cost, repeat('I', k) || 'D' AS edits FROM signed s, inserts
  UNION ALL
  SELECT s.conv_id, place, st, st_next, 3 * k + extra, repeat('I', k) || 'K' FROM signed s JOIN keeps USING (initial) JOIN inserts USING (mid) WHERE NOT forced
  UNION ALL
  SELECT s.conv_id, place, st, st_next, 3 * k + 3 + extra, repeat('I', k) || 'R' FROM signed s, inserts JOIN reroles USING (mid) WHERE NOT forced),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk(conv_id, place, st, best) AS (
  SELECT conv_id, 0::BIGINT, 0, '0000000000' FROM ids
  UNION ALL
  SELECT w.conv_id, w.place + 1, t.st_next, min(printf('%010d', left(best, 10)::BIGINT + t.cost) || substr(best, 11) || edits)
  FROM walk w JOIN steps t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.place = w.place + 1 AND t.st = w.st GROUP BY w.conv_id, w.place, t.st_next),
sizes AS (SELECT ids.conv_id, count(placed.place) AS n FROM ids LEFT JOIN placed ON placed.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
finished AS (
  SELECT w.conv_id, min(printf('%010d', left(best, 10)::BIGINT + CASE st WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END) || substr(best, 11)
                        || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END) AS best
  FROM walk w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.place = n GROUP BY w.conv_id),
letters AS (
  SELECT conv_id, i, substr(substr(best, 11), i, 1) AS edit,
         length(replace(left(substr(best, 11), i), 'I', '')) AS place, length(replace(left(substr(best, 11), i), 'D', '')) AS kept
  FROM (SELECT conv_id, best, unnest(range(1, length(best) - 9)) AS i FROM finished)),
lines AS (
  SELECT l.conv_id, i, edit, kept - (CASE WHEN first_s THEN 1 ELSE 0 END) AS n, p.role, p.text
  FROM letters l LEFT JOIN placed p ON l.edit <> 'I' AND p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.place = l.place
  LEFT JOIN (SELECT l.conv_id, bool_or(l.edit = 'K' AND l.kept = 1 AND p.initial = 's') AS first_s FROM letters l JOIN placed p
             ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.place = l.place GROUP BY l.conv_id) f ON f.conv_id IS NOT DISTINCT FROM l.conv_id),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS sha
  FROM lines WHERE edit <> 'D' GROUP BY conv_id),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM placed GROUP BY conv_id)
SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       left(best, 10)::BIGINT AS cost, substr(best, 11) AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM finished f LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM f.conv_id
"""
