"""The session model over the driver's tables, as common table expressions in Spark SQL and in the oracle's dialect.

sessions and messages come from conversations, chunks from embeddings, metrics, usage facts and captures from events,
quality records from labelled documents, subscriptions from orders. A tuple holds (base tables, Spark SQL, DuckDB SQL);
one string serves both where the dialects agree.
"""

MESSAGES = "SELECT conv_id AS session_id, turn AS message_index, role, text AS content FROM {conversations}"
SESSIONS = """SELECT conv_id AS session_id, concat('p', CAST(conv_id % 6 AS STRING)) AS platform,
  substr(coalesce(min(CASE WHEN role = 'user' AND turn <= 1 THEN text END), 'Untitled'), 1, 72) AS title,
  count(*) AS n_messages, conv_id * 37 % 1009 AS updated_at FROM {conversations} GROUP BY conv_id"""
CHUNKS = "SELECT vec_id AS chunk_id, CAST(label AS BIGINT) AS session_id, vec_id % 40 AS message_index, embedding FROM {embeddings}"
QUALITY = """SELECT d.doc_id AS id, d.source AS platform, d.doc_id % 3 + 1 AS tier, d.n_chars % 101 AS score, d.doc_id % 26 AS survival,
  d.n_chars % 21 AS integrity, d.n_chars % 16 AS freshness, d.doc_id AS created_at FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""
METRICS = (
    "SELECT event_id AS id, event_type AS operation, value AS duration_ms, user_id, timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS at_s, date_format(ts, 'yyyy-MM') AS month, props FROM {events}",
    "SELECT event_id AS id, event_type AS operation, value AS duration_ms, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, strftime(ts, '%Y-%m') AS month, props FROM {events}",
)
SUBSCRIPTIONS = "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS status, o_orderdate AS created_at, o_totalprice AS amount FROM {orders}"
USERS = "SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS segment FROM {customer}"
TEXTS = "SELECT doc_id, text, lang, source FROM {documents}"
PAGES = "SELECT page_id, url, html FROM {pages}"

ADAPTERS = {
    "messages": MESSAGES, "sessions": SESSIONS, "chunks": CHUNKS, "quality": QUALITY, "metrics": METRICS,
    "subscriptions": SUBSCRIPTIONS, "users": USERS, "texts": TEXTS, "web_pages": PAGES,
}
