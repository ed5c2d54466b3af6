"""DuckDB statements for `operator_queries`, written from the rules and not from the Spark expressions."""

from threadlake.sources import captures, samples

MESSAGES = f"""messages AS (SELECT conv_id AS session_id, turn AS message_index, role, text AS content FROM conversations
    UNION ALL {samples.values(samples.MESSAGES, samples.MESSAGE_COLUMNS)})"""
CHUNKS = """chunks AS (SELECT e.vec_id AS chunk_id, e.label::BIGINT AS session_id, e.vec_id // 10 AS message_index, e.embedding::DOUBLE[] AS embedding, d.text, coalesce(position('|' IN d.text) > 0, false) AS has_code
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"""
ASKED = "asked AS (SELECT vec_id AS query_id, label::BIGINT AS session_id, embedding::DOUBLE[] AS wanted FROM embeddings WHERE vec_id % 100 = 0)"
PAGES = """web AS (SELECT page_id, ['chatgpt','claude','grok','gemini','deepseek','perplexity'][page_id % 6 + 1] AS platform, url, html FROM pages
    UNION ALL SELECT * FROM (VALUES (-1, 'chatgpt', 'https://Chat.example.com/c/ab-12?model=x&c=77', ''), (-2, 'grok', 'https://g.example.com/chat/zz9?rid=5&q=1', ''), (-3, 'grok', 'https://g.example.com/conversation/y?rid=5', ''),
    (-4, 'gemini', 'https://m.example.com/app/id7/?a=1#top', ''), (-5, 'claude', 'https://c.example.com/chat/q-1/', ''), (-6, 'deepseek', 'https://d.example.com/a/chat/s/k2', ''), (-7, 'claude', 'no address', '')) v)"""
SNAPSHOTS = f"{captures.SQL}, snapshots AS ({samples.values(samples.SNAPSHOTS, samples.SNAPSHOT_COLUMNS)} UNION ALL SELECT session_id, source, message_index, role, content, updated_at, name FROM captures)"
SIZES = f"""WITH {SNAPSHOTS}, stored AS (SELECT session_id, count(*) AS n FROM snapshots WHERE source = 'stored' GROUP BY ALL),
    incoming AS (SELECT session_id, count(*) AS n FROM snapshots WHERE source = 'incoming' GROUP BY ALL)"""
PARTS = r"""parts AS (SELECT session_id, message_index, role, generate_subscripts(p, 1) - 1 AS part_index, unnest(p) AS part FROM (
      SELECT *, string_split('p' || regexp_replace(content, '```(\w*)\n?(.*?)```', chr(1) || 'c\1' || chr(2) || '\2' || chr(1) || 'p', 'gs'), chr(1)) AS p FROM messages WHERE content <> ''))"""


def _points(text: str) -> str:
    return f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: unicode(c)::HUGEINT)"


def _hash(text: str, start: int, step: str) -> str:
    return f"list_reduce(list_prepend({start}::HUGEINT, {_points(text)}), lambda h, c: {step})"


def _djb2(text: str) -> str:
    return _hash(text, 5381, "(h * 33 + c) % 4294967296")


def _chain(text: str, *pairs: tuple[str, str, str]) -> str:
    for pattern, by, how in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{by}', '{how}')"
    return text


_CLEAN = _chain(
    "part[2:]", ("(?m)^(sure|great|of course|absolutely|certainly|ok|okay)[!.,]?\\s*", " ", "i"), ("(?m)^(i understand|i see|i''ll help|let me|i can help)[^.!?]*[.!?]\\s*", " ", "i"),
    ("(?m)^#{1,6}\\s+", " ", "g"), ("\\*{1,2}([^*]+)\\*{1,2}", " ", "g"), ("_{1,2}([^_]+)_{1,2}", " ", "g"), ("(?m)^\\s*[-*+]\\s+", " ", "g"), ("(?m)^\\s*\\d+\\.\\s+", " ", "g"),
    ("\\n{3,}", " ", "g"), ("[ \\t]{2,}", " ", "g"), ("^\\s+|\\s+$", "", "g"),
)
_SAFE = lambda c: _chain(
    c, ("<script.*?(?:</script>|$)", "[SCRIPT REMOVED]", "gis"), ("javascript\\s*:", "javascript_REMOVED:", "gi"), ("vbscript\\s*:", "vbscript_REMOVED:", "gi"),
    ("data(\\s*):image/", "\x01\\1:image/", "gi"), ("data\\s*:", "data_REMOVED:", "gi"), ("\x01", "data", "g"),
    ("\\bon\\w{2,15}\\s*=", "onEVENT_REMOVED=", "gi"), ("</?(iframe|object|embed|form|input|base|applet|meta|link)\\b[^>]*>", "[TAG REMOVED]", "gi"),
    ("\\[\\s*SYSTEM\\s*\\]", "[SYSTEM_TAG_SANITIZED]", "gi"), ("<<<\\s*INSTRUCTIONS\\s*>>>", "[INSTRUCTIONS_TAG_SANITIZED]", "gi"),
)
_SECRET = "[CREDENTIAL REDACTED]"
_SCRUBBED = _chain("c", ("Bearer\\s+[A-Za-z0-9\\-._~+/]+=*", _SECRET, "g"), ("Authorization:\\s*\\S+", _SECRET, "gi"), ("sk-[A-Za-z0-9]{20,}", _SECRET, "g"), ("api[_-]?key[\\s:=]+[\"'']?[A-Za-z0-9\\-._]{16,}[\"'']?", _SECRET, "gi"))


def _has(pattern: str, how: str = "c", text: str = "c") -> str:
    return f"regexp_matches({text}, '{pattern}', '{how}')"


def _weights(*scores: tuple[str, str, int]) -> str:
    return "round(least(10e0, " + " + ".join(f"CASE WHEN {_has(p, h)} THEN {w} ELSE 0 END" for p, h, w in scores) + " + least(1e0, length(c) / 400e0)), 6)"


_CAUSE = "\\broot cause\\b|\\bcaused by\\b|\\bfixed by\\b|\\bresolved by\\b"
_DECISION = _weights((_CAUSE, "i", 3), ("\\bdecided\\b|\\bchose\\b|\\bopted for\\b|\\bwent with\\b|\\bgoing with\\b", "i", 2), ("\\binstead of\\b|\\brather than\\b|\\bswitching to\\b|\\bmigrating to\\b", "i", 2), ("`[^`]+`|\\b[A-Z][a-zA-Z]+Error\\b", "c", 2), ("\\bthis works because\\b|\\bthe reason\\b|\\bbecause of\\b", "i", 1))
_BUG = _weights((_CAUSE, "i", 4), ("\\b[A-Z][a-zA-Z]+(?:Error|Exception)\\b", "c", 3), ("\\brace condition\\b|\\bnull pointer\\b|\\bmemory leak\\b|\\bdeadlock\\b", "i", 3), ("\\bworkaround\\b|\\bhotfix\\b|\\bpatched\\b", "i", 1), ("\\bbreak(?:ing|s)\\b|\\bfail(?:ing|ed|s)\\b", "i", 2), ("\\bfailed to\\b|\\bnot (?:found|matching|detecting)\\b", "i", 2), ("\\bHTTP [45]\\d\\d\\b", "i", 2))
_FLUFF = "regexp_replace(regexp_replace(c, '^(?:(?:can|could|would|will|please|just|basically|actually|i was wondering|sure|of course|i''d like to|i need to|help me|hi|hello|hey)[,\\s]+)+', '', 'i'), '^\\s+|\\s+$', '', 'g')"
_COS = "coalesce(list_cosine_similarity(embedding, wanted), 0)"
_RECENT = "greatest(0, last - CASE WHEN last < 60 THEN 6 WHEN last < 200 THEN 10 ELSE 15 END + 1)"

ORACLES = {
    "chunked_messages": rf"""WITH {MESSAGES}, {PARTS},
        code AS (SELECT session_id, message_index, part_index, 0 AS piece_index, role, split_part(part, chr(2), 2) AS text, true AS has_code, nullif(split_part(part, chr(2), 1)[2:], '') AS language FROM parts
            WHERE part[1] = 'c' AND trim(split_part(part, chr(2), 2), ' ' || chr(9) || chr(10) || chr(13)) <> ''),
        prose AS (SELECT *, {_CLEAN} AS cleaned FROM parts WHERE part[1] = 'p'),
        folded AS (SELECT *, CASE WHEN length(cleaned) <= 800 THEN [cleaned] ELSE list_transform([list_reduce(list_transform(string_split(regexp_replace(cleaned, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
            lambda s: {{'d': []::VARCHAR[], 'o': s}}), lambda x, y: CASE WHEN length(x.o) + length(y.o) > 800 AND x.o <> '' THEN {{'d': list_append(x.d, x.o), 'o': y.o}} ELSE {{'d': x.d, 'o': x.o || ' ' || y.o}} END)], lambda r: list_append(r.d, r.o))[1] END AS pieces
            FROM prose WHERE length(cleaned) >= 20),
        pieces AS (SELECT session_id, message_index, part_index, generate_subscripts(pieces, 1) - 1 AS piece_index, role, unnest(pieces) AS text, false AS has_code, NULL AS language FROM folded),
        every AS (SELECT * FROM code UNION ALL SELECT * FROM pieces WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 20),
        placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC, part_index DESC, piece_index DESC) AS r FROM every)
        SELECT session_id, message_index, part_index, piece_index, role, text, has_code, language, ceil(length(text) / 4e0)::BIGINT AS token_count FROM placed WHERE r <= 2000""",
    "code_blocks": rf"""WITH {MESSAGES}, {PARTS}, code AS (SELECT session_id, message_index, part_index, split_part(part, chr(2), 1)[2:] AS language, split_part(part, chr(2), 2) AS c FROM parts WHERE part[1] = 'c')
        SELECT session_id, message_index, part_index, language, length(c) AS size, CASE WHEN {_has("import React|ReactDOM|jsx|tsx|<\\w+\\s*/>")} THEN 'typescript' WHEN {_has("def\\s+\\w+\\(|from\\s+\\w+\\s+import|print\\(")} THEN 'python'
        WHEN {_has("fn\\s+\\w+|let mut |impl\\s+\\w+|use std::")} THEN 'rust' WHEN {_has("func\\s+\\w+|package\\s+\\w+|:=|fmt\\.")} THEN 'go' WHEN {_has("class\\s+\\w+|function\\s+\\w+|const\\s+\\w+\\s*=")} THEN 'javascript' ELSE 'unknown' END AS guessed FROM code""",
    "message_hashes": f"""WITH {MESSAGES}, m AS (SELECT session_id, message_index, role || ':' || coalesce(content, '')[:100] AS head, role || length(coalesce(content, '')) || right(coalesce(content, ''), 20) AS tail FROM messages),
        h AS (SELECT *, {_djb2("head")} AS a, {_djb2("tail")} AS b FROM m)
        SELECT session_id, message_index, lower(to_base(a::BIGINT, 36)) AS head_hash, CASE WHEN b >= 2147483648 THEN '-' || lower(to_base((4294967296 - b)::BIGINT, 36)) ELSE lower(to_base(b::BIGINT, 36)) END AS tail_hash,
        {_hash("head", 5381, "xor(((h * 33) % 4294967296)::BIGINT, c::BIGINT)::HUGEINT")}::BIGINT AS xor_hash FROM h""",
    "session_hashes": f"""WITH {MESSAGES}, s AS (SELECT session_id, string_agg(role || ':' || coalesce(content, '')[:100], '|' ORDER BY message_index) AS s FROM messages GROUP BY session_id)
        SELECT session_id, lower(to_base({_djb2("s")}::BIGINT, 36)) AS hash FROM s""",
    "url_keys": rf"""WITH {PAGES}, u AS (SELECT page_id, platform, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_replace(url, '^https?://|#.*$', '', 'g') AS bare FROM web),
        k AS (SELECT *, CASE platform WHEN 'grok' THEN array_to_string(list_filter(string_split(query, '&'), lambda p: NOT (p = 'rid' OR p LIKE 'rid=%')), '&')
            WHEN 'chatgpt' THEN regexp_extract('&' || query, '&(c=[^&]+)', 1) WHEN 'perplexity' THEN '' WHEN 'gemini' THEN '' ELSE query END AS kept FROM u)
        SELECT page_id, platform || '::' || CASE WHEN host = '' THEN url ELSE regexp_replace(lower(host) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END, '/$', '') END AS url_key,
        regexp_extract(path, CASE platform WHEN 'chatgpt' THEN '^/c/([a-zA-Z0-9-]+)' WHEN 'claude' THEN '^/chat/([a-zA-Z0-9-]+)' WHEN 'grok' THEN '^/(?:chat|conversation)/([a-zA-Z0-9-]+)' WHEN 'gemini' THEN '^/app/([a-zA-Z0-9-]+)' WHEN 'deepseek' THEN '^/(?:a/chat/s|chat)/([a-zA-Z0-9-]+)' ELSE '^$()' END, 1) AS native_id,
        platform || '-' || lower(to_base({_hash("bare", 7, "(h * 31 + c) % 4294967296")}::BIGINT, 36)) AS legacy_id FROM k""",
    "sanitised_pages": f"WITH {PAGES} SELECT page_id, {_SAFE('html')} AS html FROM web",
    "sanitised_messages": rf"""WITH {MESSAGES}, m AS (SELECT session_id, message_index, coalesce(content, '') AS c, replace(replace(replace(replace(coalesce(content, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS e FROM messages)
        SELECT session_id, message_index, {_SAFE('c')} AS safe, {_SCRUBBED} AS scrubbed, replace(e, '''', '&#x27;') AS xml, left(replace(replace(replace(e, '''', '&apos;'), chr(10), ' '), chr(13), ' '), 200) AS attribute,
        '<![CDATA[' || replace(c, ']]>', ']]]]><![CDATA[>') || ']]>' AS cdata, left(regexp_replace(lower(c), '[^a-z0-9]+', '-', 'g'), 30) AS slug FROM m""",
    "message_predicates": rf"""WITH {MESSAGES}, m AS (SELECT session_id, message_index, role, coalesce(content, '') AS c FROM messages), f AS (SELECT *, {_FLUFF} AS clean FROM m),
        g AS (SELECT *, regexp_replace(split_part(regexp_replace(clean, '[.!?\n]', chr(1), 'g'), chr(1), 1), '^\s+|\s+$', '', 'g') AS sentence FROM f)
        SELECT session_id, message_index, {_has("^(?:sure|of course|absolutely|certainly|got it|understood|okay|ok|alright|happy to help|great|sounds good|will do|no problem|perfect)[!.,]?\\s*(?:i[''’]?ll|let me|here[''’]?s|i can|to)?\\s*[^a-zA-Z]*$", "i", "regexp_replace(c, '^\\s+|\\s+$', '', 'g')")} AS acknowledgement,
        {_has("\\b(Traceback|TypeError|ValueError|ReferenceError|SyntaxError|RuntimeError|AttributeError|NameError|ImportError|KeyError|IndexError|ZeroDivisionError)\\b")} OR {_has("\\bat\\s+\\w[\\w.]*\\s+\\([^)]+:\\d+:\\d+\\)")} OR {_has("\\bError:\\s+\\S")} OR {_has("Exception\\s+in\\s+thread")} AS error,
        starts_with(c, 'You are a') OR starts_with(c, 'Read every file') OR starts_with(c, 'TASK —') OR starts_with(c, 'REQUIRED') OR coalesce(list_sum(list_transform(regexp_extract_all(c, '(?s)```.*?```'), lambda b: length(b))), 0) > 0.4e0 * length(c) AS prompt,
        length(c) >= 30 AND ((length(list_distinct(list_transform(regexp_extract_all(c, '(?i)\b(?:GPT-?[34o]|Haiku|Sonnet|Opus|Llama|Mistral|Gemma|Qwen|Kimi|Copilot)\b'), lambda x: lower(x)))) >= 5
            AND {_has("\\b(?:benchmark|leaderboard|eval(?:uation)?|ranking|compared? to|versus|vs|outperform|scores? higher)\\b", "i")}) OR {_has("\\bSWE[- ]bench\\b", "i")}) AS meta,
        left(CASE WHEN sentence <> '' THEN sentence ELSE clean END, 150) AS request, {_DECISION} AS decision, {_BUG} AS bug, role || '::' || trim(regexp_replace(left(c, 80), '\s+', ' ', 'g')) AS fingerprint FROM g""",
    "file_chunk_sizes": """WITH s AS (SELECT doc_id AS file_id, text, unnest(range(0, length(text), 400)) AS start FROM documents WHERE text <> '')
        SELECT file_id, start // 400 AS chunk_index, length(text[start + 1:start + 500]) AS size, md5(text[start + 1:start + 500]) AS md5 FROM s""",
    "sampled_chunks": """WITH n AS (SELECT label::BIGINT AS session_id, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT session_id, n, unnest(range(0, n)) AS place FROM n)
        SELECT session_id, place FROM p WHERE n <= 20 OR place < 2 OR place >= n - 8 OR place IN (SELECT floor(2 + i * ((n - 10) / 10e0))::BIGINT FROM range(0, 10) t(i))""",
    "best_per_session": f"""WITH {ASKED}, s AS (SELECT query_id, label::BIGINT AS session_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], wanted), 6) AS score FROM embeddings, asked),
        b AS (SELECT *, row_number() OVER (PARTITION BY query_id, session_id ORDER BY score DESC, chunk_id) AS rn FROM s),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id) AS k FROM b WHERE rn = 1) SELECT query_id, session_id, chunk_id, score FROM t WHERE k <= 5""",
    "nearest_chunks": f"""WITH {ASKED}, s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], wanted), 6) AS score FROM embeddings, asked),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM s) SELECT query_id, chunk_id, score FROM t WHERE k <= 10""",
    "searched_everywhere": f"""WITH {ASKED}, s AS (SELECT query_id, vec_id % 61 AS session_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], wanted), 6) AS score FROM embeddings, asked)
        SELECT query_id, session_id, chunk_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""",
    "searched_near_sessions": f"""WITH {ASKED}, d AS (SELECT vec_id % 61 AS session_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), a AS (SELECT session_id, i, avg(x) AS x FROM d GROUP BY ALL), c AS (SELECT session_id, list(x ORDER BY i) AS middle FROM a GROUP BY session_id),
        n AS (SELECT query_id, c.session_id FROM c, asked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(middle, wanted), 6) DESC, c.session_id) <= 20),
        s AS (SELECT query_id, n.session_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], wanted), 6) AS score FROM n JOIN asked USING (query_id) JOIN embeddings ON vec_id % 61 = n.session_id)
        SELECT query_id, session_id, chunk_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""",
    "session_centroids": """WITH d AS (SELECT label::BIGINT AS session_id, generate_subscripts(embedding, 1) - 1 AS dimension, unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT session_id, count(*) AS n, dimension, round(avg(x), 6) AS x FROM d GROUP BY session_id, dimension""",
    "message_centroids": """WITH d AS (SELECT label::BIGINT AS session_id, vec_id // 10 AS message_index, generate_subscripts(embedding, 1) - 1 AS dimension, unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT session_id, message_index, count(*) AS n, dimension, round(avg(x), 6) AS x FROM d GROUP BY ALL""",
    "retrieved_chunks": rf"""WITH {CHUNKS}, {ASKED}, s AS (SELECT query_id, c.session_id, chunk_id, message_index, has_code, text, max(message_index) OVER (PARTITION BY query_id) AS last, round({_COS}, 9) AS cos FROM chunks c JOIN asked q ON c.session_id = q.session_id),
        b AS (SELECT *, round(cos + CASE WHEN last > 0 THEN 0.15e0 * message_index / last ELSE 0 END
            + CASE WHEN coalesce({_has("\\b(?:we decided|the fix is|root cause|the issue was|bug was|the goal|next step|TypeError|ReferenceError|Traceback|throws? \\w+Error|fails? with|caused by)\\b", "i", "text")}, false) THEN 0.1e0 ELSE 0 END
            + CASE WHEN has_code THEN 0.05e0 ELSE 0 END + least(0.05e0, coalesce(length(text), 0) / 6000e0), 6) AS score, message_index >= {_RECENT} AS recent, bool_or(cos >= 0.05) OVER (PARTITION BY query_id) AS usable FROM s),
        code AS (SELECT query_id, chunk_id FROM b WHERE has_code AND (cos >= 0.05 OR NOT usable) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5),
        n AS (SELECT query_id, count(*) AS n FROM code GROUP BY query_id),
        prose AS (SELECT b.query_id, chunk_id FROM b LEFT JOIN n USING (query_id) WHERE NOT has_code AND (cos >= 0.05 OR NOT usable) QUALIFY row_number() OVER (PARTITION BY b.query_id ORDER BY score DESC, chunk_id) <= 15 - coalesce(n.n, 0)),
        kept AS (SELECT * FROM code UNION SELECT * FROM prose UNION SELECT query_id, chunk_id FROM b WHERE recent)
        SELECT query_id, session_id, chunk_id, message_index, score, recent FROM b JOIN kept USING (query_id, chunk_id)""",
    "keyword_retrieved": rf"""WITH {CHUNKS}, c AS (SELECT *, max(message_index) OVER (PARTITION BY session_id) AS last FROM (SELECT * FROM chunks WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC, chunk_id DESC) <= 200)),
        s AS (SELECT *, round(length(regexp_extract_all(lower(text), 'the')) + length(regexp_extract_all(lower(text), 'ing')) + length(regexp_extract_all(lower(text), 'root')) + length(regexp_extract_all(lower(text), 'schema'))
            + CASE WHEN has_code THEN 0.5e0 ELSE 0 END + CASE WHEN last > 0 THEN 0.15e0 * message_index / last ELSE 0 END, 6) AS score, message_index >= {_RECENT} AS recent FROM c),
        r AS (SELECT session_id, count(*) AS n FROM s WHERE recent GROUP BY session_id),
        top AS (SELECT s.* FROM s LEFT JOIN r USING (session_id) WHERE NOT recent QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, chunk_id) <= 15 - coalesce(r.n, 0)),
        u AS (SELECT * FROM s WHERE recent UNION ALL SELECT * FROM top)
        SELECT session_id, chunk_id, message_index, score, recent FROM u QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_index, chunk_id) <= 15""",
    "keyword_search": f"""WITH {CHUNKS}, w AS (SELECT unnest(['the', 'ing', 'root', 'schema', 'the']) AS w)
        SELECT chunk_id, round(avg(CASE WHEN contains(lower(text), w) THEN 1e0 ELSE 0e0 END), 6) AS score FROM chunks, w WHERE text IS NOT NULL GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 25""",
    "boosted_chunks": f"""WITH RECURSIVE {CHUNKS}, s AS (SELECT session_id, chunk_id, (chunk_id * 37 % 101) / 100e0 AS score, row_number() OVER (PARTITION BY session_id ORDER BY chunk_id) AS i, lead((chunk_id * 37 % 101) / 100e0) OVER (PARTITION BY session_id ORDER BY chunk_id) AS ahead FROM chunks),
        walk AS (SELECT session_id, i, score AS now FROM s WHERE i = 1
            UNION ALL SELECT s.session_id, s.i, CASE WHEN s.score < 0.7e0 AND s.score >= 0.65e0 * 0.7e0 AND w.now >= 0.7e0 THEN 0.7e0 ELSE s.score END FROM walk w JOIN s ON s.session_id = w.session_id AND s.i = w.i + 1)
        SELECT s.session_id, chunk_id, score, CASE WHEN now < 0.7e0 AND score >= 0.65e0 * 0.7e0 AND ahead >= 0.7e0 THEN 0.7e0 ELSE now END AS boosted FROM s JOIN walk USING (session_id, i)""",
    "attention_chunks": f"""WITH RECURSIVE {CHUNKS}, {ASKED}, s AS (SELECT query_id, c.session_id, chunk_id, message_index, round({_COS}, 6) AS score FROM chunks c JOIN asked q ON c.session_id = q.session_id),
        o AS (SELECT *, row_number() OVER w AS i, lead(score) OVER w AS ahead, max(message_index) OVER (PARTITION BY query_id) AS last FROM s WINDOW w AS (PARTITION BY query_id ORDER BY message_index, chunk_id)),
        walk AS (SELECT query_id, i, score AS now FROM o WHERE i = 1
            UNION ALL SELECT o.query_id, o.i, CASE WHEN o.score < 0.4e0 AND o.score >= 0.65e0 * 0.4e0 AND w.now >= 0.4e0 THEN 0.4e0 ELSE o.score END FROM walk w JOIN o ON o.query_id = w.query_id AND o.i = w.i + 1),
        b AS (SELECT o.*, CASE WHEN now < 0.4e0 AND score >= 0.65e0 * 0.4e0 AND ahead >= 0.4e0 THEN 0.4e0 ELSE now END AS boosted FROM o JOIN walk USING (query_id, i)),
        t AS (SELECT *, boosted >= 0.4e0 AND row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, message_index, chunk_id) <= 100 AS top FROM b)
        SELECT query_id, session_id, chunk_id, message_index, CASE WHEN top THEN boosted ELSE 1e0 END AS score FROM t WHERE top OR message_index > last - 6""",
    "category_scores": """WITH c AS (SELECT vec_id AS category, embedding::DOUBLE[] AS wanted FROM embeddings WHERE vec_id < 5), s AS (SELECT vec_id AS id, category, round(list_cosine_similarity(embedding::DOUBLE[], wanted), 6) AS score FROM embeddings, c)
        SELECT id, category, score, max(score) OVER (PARTITION BY id) AS best FROM s""",
    "upserted_subscriptions": """SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'renewed' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS amount,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderdate ELSE o_orderdate + INTERVAL 9 DAY END AS created_at FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT'""",
    "known_snapshots": f"""{SIZES} SELECT coalesce(s.session_id, i.session_id) AS session_id, greatest(coalesce(s.n, 0), coalesce(i.n, 0)) AS n, CASE WHEN i.n IS NOT NULL AND i.n >= coalesce(s.n, 0) THEN 'pending' ELSE 'stored' END AS source FROM stored s FULL JOIN incoming i ON s.session_id = i.session_id""",
    "accepted_snapshots": f"""{SIZES} SELECT i.session_id, i.n, 'shrink' AS rule FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.session_id = i.session_id AND s.n > i.n)
        UNION ALL SELECT i.session_id, i.n, 'history' FROM incoming i LEFT JOIN stored s ON s.session_id = i.session_id WHERE i.n >= 2 AND i.n >= 0.8 * coalesce(s.n, 0)""",
    "merged_messages": rf"""WITH {SNAPSHOTS}, f AS (SELECT *, role || '::' || trim(regexp_replace(left(content, 80), '\s+', ' ', 'g')) AS fp, CASE WHEN source = 'stored' THEN row_number() OVER (PARTITION BY session_id, source, role || '::' || trim(regexp_replace(left(content, 80), '\s+', ' ', 'g')) ORDER BY message_index) ELSE 1 END AS nth FROM snapshots),
        a AS (SELECT session_id, fp, nth, min(CASE WHEN source = 'stored' THEN message_index ELSE 1000000 + message_index END) AS first_at, arg_max({{'role': role, 'content': content}}, length(content) * 1e9 + CASE WHEN source = 'stored' THEN 0 ELSE 1e6 END + message_index) AS m FROM f GROUP BY session_id, fp, nth)
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY first_at) - 1 AS place, m.role, m.content FROM a""",
    "better_sessions": f"""WITH {SNAPSHOTS}, e AS (SELECT session_id, source, count(*) AS n, arg_min(left(content, 200), message_index) AS a, arg_max(left(content, 200), message_index) AS z, any_value(updated_at) AS t, max(name) AS name FROM snapshots GROUP BY session_id, source),
        j AS (SELECT coalesce(l.session_id, r.session_id) AS session_id, l.n AS ln, r.n AS rn, l.t AS lt, r.t AS rt, l.name AS lname, r.name AS rname, l.a <> r.a AND l.z <> r.z AND greatest(l.n, r.n) <= 3 * least(l.n, r.n) AS clash FROM (SELECT * FROM e WHERE source = 'stored') l FULL JOIN (SELECT * FROM e WHERE source = 'incoming') r ON l.session_id = r.session_id),
        w AS (SELECT *, CASE WHEN rn IS NULL OR clash THEN 'local' WHEN ln IS NULL THEN 'remote' WHEN ln <> rn THEN CASE WHEN ln > rn THEN 'local' ELSE 'remote' END WHEN rt > lt THEN 'remote' ELSE 'local' END AS winner FROM j)
        SELECT session_id, winner, CASE winner WHEN 'local' THEN ln ELSE rn END AS n, CASE winner WHEN 'local' THEN lt ELSE rt END AS updated_at,
        CASE WHEN ln IS NULL OR rn IS NULL OR clash OR (coalesce(trim(lname), '') = '' AND coalesce(trim(rname), '') = '') THEN CASE winner WHEN 'local' THEN lname ELSE rname END
             WHEN coalesce(trim(rname), '') = '' THEN lname WHEN coalesce(trim(lname), '') = '' THEN rname WHEN rt > lt THEN rname ELSE lname END AS name FROM w""",
    "newest_templates": """WITH o AS (SELECT o_custkey AS id, o_orderstatus AS s, o_orderkey AS version, o_orderdate AS updated_at FROM orders WHERE o_orderstatus IN ('O', 'F') QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        SELECT id, version, updated_at FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, s DESC) = 1""",
    "cascade_deleted": " UNION ALL ".join(f"SELECT {c} AS session_id, count(*) AS n, '{t}' AS table_name FROM {t} WHERE {c} NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY {c}" for t, c in (
        ("conversations", "conv_id"), ("orders", "o_custkey"), ("embeddings", "vec_id"), ("events", "user_id"), ("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"), ("lineitem", "l_suppkey"), ("customer", "c_custkey"))),
    "orphan_chunks": "SELECT vec_id AS chunk_id, label::BIGINT AS session_id FROM embeddings WHERE vec_id NOT IN (SELECT conv_id FROM conversations)",
    "newest_tombstones": """WITH o AS (SELECT o_custkey AS session_id, arg_max(o_orderdate, CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 1000 YEAR ELSE o_orderdate END) AS deleted_at FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_custkey)
        SELECT session_id, deleted_at FROM o ORDER BY deleted_at DESC, session_id LIMIT 200""",
    "first_sync": """SELECT c_custkey AS session_id, 'seed' AS action FROM customer WHERE c_custkey NOT IN (SELECT conv_id FROM conversations)
        UNION ALL SELECT DISTINCT conv_id, 'upload' FROM conversations WHERE conv_id NOT IN (SELECT c_custkey FROM customer)""",
    "manifest_status": """WITH m AS (SELECT conv_id AS session_id, count(*) AS n FROM conversations GROUP BY conv_id), c AS (SELECT label::BIGINT AS session_id, count(*) AS k FROM embeddings GROUP BY label)
        SELECT m.session_id, m.session_id % 3 <> 0 AND k IS NOT NULL AND 2 * k >= n AS is_complete FROM m LEFT JOIN c ON m.session_id = c.session_id""",
    "sessions_needing_index": """WITH m AS (SELECT conv_id AS session_id, count(*) AS n, max(turn) AS t FROM conversations GROUP BY conv_id), c AS (SELECT label::BIGINT AS session_id, count(*) AS k FROM embeddings GROUP BY label)
        SELECT m.session_id, CASE WHEN m.session_id % 7 = 0 THEN true WHEN m.session_id % 3 <> 0 AND k > 0 THEN false WHEN m.session_id % 3 = 0 THEN true WHEN t <> n OR m.session_id % 5 = 0 THEN true ELSE coalesce(k, 0) < 8 * n END AS needed FROM m LEFT JOIN c ON m.session_id = c.session_id""",
    "counted_requests": "WITH r AS (SELECT event_id AS id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m'), event_type ORDER BY ts, event_id) AS k FROM events) SELECT id, least(k, 3) AS used, k <= 3 AS allowed FROM r",
    "usage_decisions": """WITH l(tier, allowance) AS (VALUES ('click', 10), ('view', 20), ('purchase', 5)), u AS (SELECT user_id, event_type AS tier, count(*) AS used FROM events GROUP BY ALL)
        SELECT user_id, tier, used, allowance::BIGINT AS allowance, true AS allowed, CASE WHEN used >= allowance THEN 999 ELSE allowance - used END::BIGINT AS remaining, CASE WHEN used >= allowance THEN 'limit_reached_promotional_unlocked' END AS reason FROM u JOIN l USING (tier)""",
    "request_windows": """WITH RECURSIVE e AS (SELECT user_id AS k, floor(epoch(ts))::BIGINT AS s, event_id AS id FROM events),
        opened AS (SELECT k, min(s) AS start FROM e GROUP BY k UNION ALL SELECT o.k, (SELECT min(e.s) FROM e WHERE e.k = o.k AND e.s >= o.start + 86400) AS start FROM opened o WHERE o.start IS NOT NULL),
        p AS (SELECT e.k, e.s, e.id, (SELECT max(o.start) FROM opened o WHERE o.k = e.k AND o.start <= e.s) AS start FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY k, start ORDER BY s, id) AS n FROM p)
        SELECT k AS "key", s AS "at", id, n <= 3 AS ok, greatest(0, 3 - n) AS remaining, CASE WHEN n <= 3 THEN 0 ELSE start + 86400 - s END AS retry_after FROM n""",
    "adaptive_timeouts": """WITH s AS (SELECT event_type, event_id, ts, value / greatest(user_id % 4, 1) AS x FROM events),
        w AS (SELECT event_id, list(x) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS r FROM s)
        SELECT event_id AS id, round(CASE WHEN len(r) < 3 THEN 15e0 ELSE least(90e0, greatest(15e0, 3 * list_sort(r)[least(floor(len(r) * 0.95e0)::INT, len(r) - 1) + 1])) END, 6) AS timeout FROM w""",
}
