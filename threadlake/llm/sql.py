"""SQL twins of the queries that SQL can express, for DuckDB."""

RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c
  FROM (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS p FROM t))
), rep AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM win WHERE c > 1) GROUP BY doc_id
), f AS (
  SELECT t.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id)
), v AS (
  SELECT lang, source, unnest([0, 1, 2, 3]) AS rate,
         unnest([n_symbols * 1000 // n_words, n_dup_lines * 1000 // n_words, n_repeat_words * 1000 // n_words, word_chars * 1000 // n_words]) AS x
  FROM f WHERE n_words > 0
), s AS (
  SELECT lang, source, rate, CASE WHEN x < 128 THEN x ELSE (length(bin(x)) - 7) * 64 + (x >> (length(bin(x)) - 7)) END AS bucket, count(*) AS n
  FROM v GROUP BY ALL
), g AS (
  SELECT 0 AS lv, lang, source, rate, bucket, sum(n) AS n FROM s GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, rate, bucket, sum(n) FROM s GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rate, bucket, sum(n) FROM s GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, rate) AS total FROM g
), b AS (
  SELECT lv, lang, source, rate, max(total) AS total, min(bucket) FILTER (upto * 4 >= total) AS b1, min(bucket) FILTER (upto * 4 >= total * 3) AS b3
  FROM c GROUP BY ALL
), q AS (
  SELECT lv, lang, source, rate, total,
         CASE WHEN b1 < 128 THEN b1 ELSE (b1 - (b1 // 64 - 1) * 64) << (b1 // 64 - 1) END AS low,
         CASE WHEN b3 < 128 THEN b3 ELSE (b3 - (b3 // 64 - 1) * 64) << (b3 // 64 - 1) END AS high
  FROM b
), m AS (
  SELECT a.lang, a.source, a.rate,
         CASE WHEN a.total >= 50 THEN a.low WHEN l.total >= 50 THEN l.low ELSE w.low END AS low,
         CASE WHEN a.total >= 50 THEN a.high WHEN l.total >= 50 THEN l.high ELSE w.high END AS high
  FROM q a JOIN q l ON l.lv = 1 AND l.lang = a.lang AND l.rate = a.rate JOIN q w ON w.lv = 2 AND w.rate = a.rate WHERE a.lv = 0
), lim AS (
  SELECT lang, source,
         max(high + greatest((high - low) * 3, 100)) FILTER (rate = 0) AS m0, max(high + greatest((high - low) * 3, 100)) FILTER (rate = 1) AS m1,
         max(high + greatest((high - low) * 3, 200)) FILTER (rate = 2) AS m2, max(high + greatest((high - low) * 3, 500)) FILTER (rate = 3) AS m3,
         max(low - greatest((high - low) * 3, 500)) FILTER (rate = 3) AS l3
  FROM m GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
       CASE WHEN n_words < 20 OR n_repeat_words * 100 > n_words * 30 THEN false
            ELSE n_symbols * 1000 // n_words <= m0 AND n_dup_lines * 1000 // n_words <= m1 AND n_repeat_words * 1000 // n_words <= m2
                 AND word_chars * 1000 // n_words <= m3 AND word_chars * 1000 // n_words >= l3 END AS kept
FROM f LEFT JOIN lim USING (lang, source)
"""

SUBSTRINGS = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS p FROM d)
), f AS (
  SELECT k, min(doc_id) AS least FROM w GROUP BY k
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM w JOIN f USING (k) WHERE least < doc_id
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM hit GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
  FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[p:p + 9], ' ') AS k
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS p FROM b WHERE len(ws) > 0)
), g AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS p FROM d, (SELECT DISTINCT n FROM w))
), h AS (
  SELECT doc_id, item, n, p FROM g JOIN w USING (n, k)
), c AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

PREFIX_TRIE = r"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT c, count(*) AS n FROM own GROUP BY c
), bits AS (
  SELECT v, list_reduce([v::BIGINT] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS code FROM range(256) t(v)
), codes AS (
  SELECT list(code ORDER BY v) AS l FROM bits
), h AS (
  SELECT c, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda a, b: xor(a >> 8, codes.l[xor(a, b) % 256 + 1])), 4294967295) % 6 AS h
  FROM conv, codes
), lead_n AS (
  SELECT h.c, h.h, least(h.h, coalesce(conv.n, 0)) AS m FROM h LEFT JOIN conv ON conv.c = h.c - h.c % 100
), turn AS (
  SELECT lead_n.c, i AS d, x FROM lead_n JOIN own ON own.c = lead_n.c - lead_n.c % 100 AND i <= h
  UNION ALL SELECT lead_n.c, m + i - h, x FROM lead_n JOIN own ON own.c = lead_n.c AND i > h
), path AS (
  SELECT a.c, a.d, sha256(string_agg(sha256(b.x.r) || sha256(b.x.t), '' ORDER BY b.d)) AS k, any_value(length(a.x.t)) AS chars
  FROM turn a JOIN turn b ON a.c = b.c AND b.d <= a.d GROUP BY a.c, a.d
  UNION ALL SELECT c, 0, '', 0 FROM conv
), node AS (
  SELECT k, d, min(c) AS owner, count(*) AS n_convs, any_value(chars) AS chars FROM path GROUP BY k, d
), up AS (
  SELECT DISTINCT a.k, b.k AS parent FROM path a JOIN path b ON a.c = b.c AND a.d = b.d + 1
), child AS (
  SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent
), under AS (
  SELECT p.k, sum(CASE WHEN child.k IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * node.chars) AS saved
  FROM node LEFT JOIN child USING (k) JOIN path p ON p.c = node.owner AND p.d <= node.d GROUP BY p.k
), ends AS (
  SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest FROM path JOIN (SELECT c, max(d) AS d FROM path GROUP BY c) USING (c, d) GROUP BY k
)
SELECT node.owner AS conv_id, node.d::BIGINT AS depth, parents.owner AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM node JOIN under USING (k) LEFT JOIN child USING (k) LEFT JOIN ends USING (k) LEFT JOIN up USING (k) LEFT JOIN node parents ON parents.k = up.parent
"""

HARD_NEGATIVES = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id AS id, r.label, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS place
  FROM p JOIN s USING (anchor_id) WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""
