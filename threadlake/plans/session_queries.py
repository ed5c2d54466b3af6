"""Sessions and messages: filters, joins, counts, windows, ordered picks and set operations."""

from threadlake.plans.statements import oracle, spark_query

BODIES = {
    # -- projections and filters
    "session_by_id": "SELECT session_id, platform, title FROM sessions WHERE session_id = 7",
    "sessions_of_platform": "SELECT session_id, title, updated_at FROM sessions WHERE platform = 'p2' ORDER BY updated_at DESC, session_id LIMIT 20",
    "sessions_containing": """SELECT DISTINCT s.session_id, s.title FROM sessions s LEFT JOIN messages m ON s.session_id = m.session_id
        WHERE lower(s.title) LIKE '%the%' OR lower(m.content) LIKE '%that%'""",
    "sidebar_search": """WITH ranked AS (SELECT session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) AS r FROM messages)
        SELECT s.session_id FROM sessions s LEFT JOIN ranked r ON s.session_id = r.session_id AND r.r <= 4
        GROUP BY s.session_id, s.title, s.platform
        HAVING max(CASE WHEN lower(r.content) LIKE '%on%' THEN 1 ELSE 0 END) = 1 OR lower(s.title) LIKE '%on%' OR s.platform LIKE '%on%'""",
    "valid_messages": "SELECT session_id, message_index, role, content FROM messages WHERE role IN ('user', 'assistant') AND trim(content) <> ''",
    "list_projection": """SELECT session_id, message_index, substr(content, 1, 2000) AS content, length(content) > 2000 AS truncated,
        count(*) OVER (PARTITION BY session_id) AS message_count FROM messages""",
    # -- joins
    "chunks_with_sessions": """SELECT c.chunk_id, c.session_id, s.title FROM chunks c LEFT JOIN sessions s ON c.session_id = s.session_id
        ORDER BY c.chunk_id DESC LIMIT 5000""",
    "chunks_of_platform": "SELECT c.chunk_id FROM chunks c WHERE c.session_id IN (SELECT session_id FROM sessions WHERE platform = 'p1')",
    "sessions_to_index": """SELECT s.session_id, s.n_messages FROM sessions s WHERE s.n_messages >= 3
        AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.session_id = s.session_id)""",
    "sessions_to_upload": """SELECT s.session_id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = s.session_id AND u.segment = 'BUILDING')
        AND NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = s.session_id AND u.segment = 'MACHINERY')""",
    "sync_plan": """SELECT coalesce(l.session_id, r.user_id) AS session_id,
        CASE WHEN r.user_id IS NULL THEN 'upload' WHEN l.session_id IS NULL THEN 'download'
             WHEN l.updated_at > r.user_id % 1009 THEN 'upload' WHEN l.updated_at < r.user_id % 1009 THEN 'update' ELSE 'same' END AS action
        FROM sessions l FULL OUTER JOIN (SELECT user_id FROM users WHERE user_id % 2 = 0) r ON l.session_id = r.user_id""",
    "chunk_messages": """WITH n AS (SELECT session_id, count(*) AS n FROM messages GROUP BY session_id)
        SELECT c.chunk_id, m.session_id, m.message_index, m.role FROM chunks c JOIN n ON c.session_id = n.session_id
        JOIN messages m ON m.session_id = c.session_id AND m.message_index = least(greatest(c.message_index, 0), n.n - 1)""",
    "score_by_content": """WITH best AS (SELECT content, max(length(content) % 97) AS score FROM messages WHERE role = 'assistant' GROUP BY content)
        SELECT m.session_id, m.message_index, CAST(coalesce(b.score, 0) AS BIGINT) AS score FROM messages m LEFT JOIN best b ON m.content = b.content""",
    "role_sequences": """SELECT a.message_index, count(*) AS n, CAST(sum(CASE WHEN a.role = b.role THEN 1 ELSE 0 END) AS BIGINT) AS same
        FROM messages a JOIN messages b ON a.message_index = b.message_index AND b.session_id = a.session_id + 1 GROUP BY a.message_index""",
    # -- aggregates
    "platform_counts": "SELECT platform, count(*) AS n, max(updated_at) AS newest, CAST(sum(n_messages) AS BIGINT) AS messages FROM sessions GROUP BY platform",
    "session_validation": """SELECT session_id, count(*) AS n, count(CASE WHEN role = 'user' THEN 1 END) AS n_user, count(CASE WHEN role = 'assistant' THEN 1 END) AS n_assistant,
        CAST(sum(length(content)) AS BIGINT) AS chars, max(CASE WHEN content LIKE '%```%' THEN 1 ELSE 0 END) AS has_code FROM messages GROUP BY session_id""",
    "search_scope": "SELECT count(DISTINCT session_id) AS sessions, count(*) AS messages, CAST(sum(length(content)) AS BIGINT) AS chars FROM messages",
    "compression_ratio": """WITH t AS (SELECT session_id, sum(length(content)) AS a, sum(least(length(content), 133)) AS b FROM messages GROUP BY session_id)
        SELECT session_id, CAST(greatest(0, floor((1 - b * 1e0 / a) * 100 + 0.5e0)) AS BIGINT) AS ratio FROM t WHERE a > 0""",
    "token_estimates": "SELECT session_id, CAST(sum(ceil(length(content) / 4e0)) AS BIGINT) AS tokens FROM messages GROUP BY session_id",
    # -- windows
    "session_tail": """SELECT session_id, message_index, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) AS r FROM messages) t WHERE r <= 6""",
    "head_middle_tail": """SELECT session_id, message_index, CASE WHEN r <= 2 THEN 'head' WHEN r > n - 3 THEN 'tail' ELSE 'middle' END AS part
        FROM (SELECT session_id, message_index, row_number() OVER (PARTITION BY session_id ORDER BY message_index) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM messages) t""",
    "same_role_neighbours": """SELECT session_id, count(CASE WHEN role = before THEN 1 END) AS n, count(CASE WHEN role = before THEN 1 END) > 3 AS warn
        FROM (SELECT session_id, role, lag(role) OVER (PARTITION BY session_id ORDER BY message_index) AS before FROM messages) t GROUP BY session_id""",
    "recency_boost": """SELECT session_id, message_index, round(1 + 0.2e0 * (row_number() OVER (PARTITION BY session_id ORDER BY message_index) - 1) / count(*) OVER (PARTITION BY session_id), 6) AS boost FROM messages""",
    "recent_window": """SELECT session_id, message_index FROM (SELECT session_id, message_index, row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) AS r,
        count(*) OVER (PARTITION BY session_id) AS n FROM messages) t WHERE r <= CASE WHEN n < 60 THEN 6 WHEN n < 200 THEN 10 ELSE 15 END""",
    "goal_positions": """WITH u AS (SELECT session_id, message_index, row_number() OVER (PARTITION BY session_id ORDER BY message_index) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n
        FROM messages WHERE role = 'user') SELECT session_id, max(message_index) AS goal_at FROM u
        WHERE r IN (0, CAST(floor(n * 0.25) AS BIGINT), CAST(floor(n * 0.5) AS BIGINT), CAST(floor(n * 0.75) AS BIGINT), n - 1) GROUP BY session_id""",
    "character_budget": """WITH t AS (SELECT session_id, message_index, length(content) AS len, sum(length(content)) OVER (PARTITION BY session_id) AS total,
          sum(length(content)) OVER (PARTITION BY session_id ORDER BY message_index) AS fwd, sum(length(content)) OVER (PARTITION BY session_id ORDER BY message_index DESC) AS bwd FROM messages)
        SELECT session_id, message_index, CASE WHEN fwd <= 160 THEN 'head' ELSE 'tail' END AS side FROM t WHERE fwd <= 160 OR bwd <= 640""",
    "top_quartile": """SELECT session_id, message_index FROM (SELECT session_id, message_index, row_number() OVER (PARTITION BY session_id ORDER BY length(content) DESC, message_index) AS r,
        count(*) OVER (PARTITION BY session_id) AS n FROM messages) t WHERE r <= greatest(5, CAST(floor(n * 0.25) AS BIGINT))""",
    "assistant_neighbours": """WITH t AS (SELECT session_id, message_index, role, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY message_index DESC) AS k FROM messages),
        f AS (SELECT session_id, message_index, CASE WHEN role = 'assistant' AND k <= 2 THEN 1 ELSE 0 END AS hit FROM t),
        g AS (SELECT session_id, message_index, hit, lag(hit) OVER (PARTITION BY session_id ORDER BY message_index) AS a, lead(hit) OVER (PARTITION BY session_id ORDER BY message_index) AS b FROM f)
        SELECT session_id, message_index FROM g WHERE hit = 1 OR a = 1 OR b = 1""",
    "first_real_request": """SELECT session_id, min(message_index) AS message_index FROM messages WHERE role = 'user' AND length(trim(content)) >= 20 GROUP BY session_id""",
    "last_substantive": """SELECT session_id, message_index, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) AS r FROM messages WHERE length(content) >= 20) t WHERE r <= 3""",
    "dangling_references": """WITH t AS (SELECT session_id, message_index, lower(content) AS c, lead(lower(content)) OVER (PARTITION BY session_id ORDER BY message_index) AS c1,
        lead(lower(content), 2) OVER (PARTITION BY session_id ORDER BY message_index) AS c2 FROM messages)
        SELECT session_id, message_index FROM t WHERE c1 LIKE 'it %' OR c1 LIKE 'that %' OR c1 LIKE 'this %' OR c2 LIKE 'it %' OR c2 LIKE 'that %' OR c2 LIKE 'this %'""",
    # -- sort, limit, paging
    "newest_sessions": "SELECT session_id, title FROM sessions ORDER BY updated_at DESC, session_id LIMIT 10",
    "session_page": "SELECT session_id, title FROM sessions ORDER BY updated_at DESC, session_id LIMIT 20 OFFSET 20",
    "queue_order": "SELECT session_id, n_messages FROM sessions ORDER BY n_messages DESC, session_id LIMIT 25",
    # -- set operations
    "ordered_distinct": "SELECT session_id, content, min(message_index) AS first_at FROM messages GROUP BY session_id, content",
    "delta_chunks": "SELECT chunk_id FROM chunks EXCEPT SELECT chunk_id FROM chunks WHERE chunk_id % 3 = 0",
    "indexed_sessions": "SELECT session_id FROM sessions INTERSECT SELECT session_id FROM chunks",
    "union_first_wins": """WITH u AS (SELECT session_id, message_index, 1 AS priority FROM messages WHERE role = 'assistant' AND length(content) > 200
        UNION ALL SELECT session_id, message_index, 2 FROM messages WHERE message_index >= 2)
        SELECT session_id, message_index, min(priority) AS priority FROM u GROUP BY session_id, message_index""",
    "prefix_dedupe": "SELECT session_id, substr(content, 1, 40) AS prefix, min(message_index) AS message_index, count(*) AS n FROM messages GROUP BY session_id, substr(content, 1, 40)",
    # -- scalar functions
    "titles": """WITH f AS (SELECT session_id, min(message_index) AS i FROM messages WHERE role = 'user' GROUP BY session_id)
        SELECT m.session_id, CASE WHEN length(trim(m.content)) > 72 THEN concat(substr(trim(m.content), 1, 71), '…') ELSE trim(m.content) END AS title
        FROM messages m JOIN f ON m.session_id = f.session_id AND m.message_index = f.i""",
    "escaped": """SELECT session_id, message_index, replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS content FROM messages""",
    "keyword_counts": "SELECT session_id, message_index, CAST((length(lower(content)) - length(replace(lower(content), 'the', ''))) / 3 AS BIGINT) AS n FROM messages",
    "merged_snapshots": """WITH a AS (SELECT session_id, count(*) AS n FROM messages WHERE message_index < 5 GROUP BY session_id),
        b AS (SELECT session_id, count(*) AS n FROM messages WHERE message_index % 2 = 0 GROUP BY session_id)
        SELECT coalesce(a.session_id, b.session_id) AS session_id, CASE WHEN b.n IS NOT NULL AND b.n >= coalesce(a.n, 0) THEN 'new' ELSE 'old' END AS kept,
        greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM a FULL OUTER JOIN b ON a.session_id = b.session_id""",
}

QUERIES = {name: spark_query(body) for name, body in BODIES.items()}
ORACLES = {name: oracle(body) for name, body in BODIES.items()}
