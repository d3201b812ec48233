"""DuckDB SQL with the results of those queries that SQL can state."""

OP1 = """
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS w
  FROM base GROUP BY source),
walk AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / w, w) AS r,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(w) OVER (ORDER BY 3 * source_size / w, w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         sum(source_size) OVER () AS total
  FROM src),
lvl AS (SELECT (total - spent)::DOUBLE / open_w AS lv FROM walk WHERE (total - spent)::DOUBLE / open_w * w <= cap ORDER BY r LIMIT 1),
tgt AS (
  SELECT source, source_size, least((SELECT lv FROM lvl) * w, cap::DOUBLE) AS target FROM walk),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM tgt),
rest AS (SELECT *, target - whole * source_size AS budget FROM plan),
hashes AS (SELECT source, hash, sum(size) AS words FROM base GROUP BY source, hash),
cum AS (
  SELECT source, hash, words, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM hashes),
bound AS (
  SELECT c.source, min_by(CASE WHEN upto - budget < budget - (upto - words) THEN hash + 1 ELSE hash END, hash) AS bound
  FROM cum c JOIN rest r ON c.source IS NOT DISTINCT FROM r.source WHERE upto > budget GROUP BY c.source)
SELECT b.doc_id, b.source, b.size, r.source_size, r.target,
       (b.size * (r.whole + CASE WHEN b.hash < coalesce(bd.bound, CASE WHEN r.budget > 0 THEN 1152921504606846976 ELSE 0 END) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base b JOIN rest r ON b.source IS NOT DISTINCT FROM r.source
LEFT JOIN bound bd ON b.source IS NOT DISTINCT FROM bd.source
"""
OP5 = """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
ans AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) AS r FROM t WHERE role = 'assistant'),
last AS (SELECT conv_id, turn AS lturn, text AS ltext FROM ans WHERE r = 1),
plan AS (
  SELECT l.conv_id, l.lturn, CASE WHEN n.conv_id IS NOT NULL THEN n.ltext ELSE (SELECT ltext FROM last ORDER BY conv_id LIMIT 1) END AS other
  FROM last l LEFT JOIN last n ON n.conv_id = l.conv_id + 1),
side AS (
  SELECT t.conv_id, 'chosen' AS side, turn, role, text FROM t
  UNION ALL
  SELECT t.conv_id, 'rejected', turn, role,
         CASE WHEN role = 'assistant' AND turn IS NOT DISTINCT FROM lturn THEN other ELSE text END
  FROM t LEFT JOIN plan p ON p.conv_id = t.conv_id),
clean AS (
  SELECT conv_id, side, turn, replace(replace(translate(coalesce(role, 'unknown'), chr(10) || chr(13), '  '), '<|', '< |'), '|>', '| >') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM side),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS k FROM clean),
differ AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.k, r.k)) AS k
  FROM (SELECT * FROM ranked WHERE side = 'chosen') c FULL JOIN (SELECT * FROM ranked WHERE side = 'rejected') r
    ON c.conv_id = r.conv_id AND c.k = r.k
  WHERE c.k IS NULL OR r.k IS NULL OR c.role <> r.role OR c.text <> r.text GROUP BY 1),
placed AS (
  SELECT ranked.*, coalesce(differ.k, 1 + count(*) FILTER (ranked.side = 'chosen') OVER (PARTITION BY ranked.conv_id)) AS d,
         '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM ranked LEFT JOIN differ USING (conv_id)),
offs AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, side, k >= d ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM placed)
SELECT conv_id AS pair_id, max(d) - 1 AS n_shared,
       count(*) FILTER (side = 'chosen') AS n_chosen, count(*) FILTER (side = 'rejected') AS n_rejected,
       coalesce(string_agg(head || body, '' ORDER BY k) FILTER (side = 'chosen' AND k < d), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY k) FILTER (side = 'chosen' AND k >= d), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY k) FILTER (side = 'rejected' AND k >= d), '') AS rejected,
       coalesce(string_agg((pos + length(head))::BIGINT || '-' || (pos + length(head) + length(body))::BIGINT, ',' ORDER BY k)
                FILTER (side = 'chosen' AND k >= d AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((pos + length(head))::BIGINT || '-' || (pos + length(head) + length(body))::BIGINT, ',' ORDER BY k)
                FILTER (side = 'rejected' AND k >= d AND role = 'assistant'), '') AS rejected_spans
FROM offs GROUP BY conv_id
"""

OP2 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * same >= 75 * (a.n + b.n - same)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.y), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""

OP11 = """
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM base GROUP BY text),
marks AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(ws) < 200)::INT + 2 * (100 * list_unique(ws) < 50 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(base.text, '[^A-Z]', '', 'g')) > 2 * length(base.text))::INT
         + 8 * regexp_matches(base.text, '[#$%&*|]')::INT + 16 * coalesce(base.doc_id > least, false)::INT AS mask
  FROM base JOIN least ON least.text = base.text LEFT JOIN marks ON marks.doc_id = base.doc_id),
cells AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM rows GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
walk AS (
  SELECT letter AS filter_order, letter, bit, 0 AS applied, 1 AS step FROM f
  UNION ALL
  SELECT filter_order || f.letter, f.letter, f.bit, applied | walk.bit, step + 1
  FROM walk JOIN f ON NOT contains(filter_order, f.letter)),
counted AS (
  SELECT part, filter_order, any_value(letter) AS letter, any_value(step) AS step,
         coalesce(sum(docs) FILTER (mask & (applied | bit) = 0), 0) AS kept,
         coalesce(sum(docs) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS removed,
         coalesce(sum(docs) FILTER (mask & applied <> 0 AND mask & bit <> 0), 0) AS redundant,
         coalesce(sum(docs) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM cells, walk GROUP BY part, filter_order),
steps AS (SELECT filter_order AS whole, unnest(range(1, 6)) AS k FROM walk WHERE step = 5)
SELECT part, whole AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM steps JOIN counted ON counted.filter_order = whole[1:k]
"""

ORACLE = {"op1_mixing_sources": OP1, "op2_jaccard_join": OP2, "op5_chat_formatting": OP5, "op11_filter_audit": OP11}
