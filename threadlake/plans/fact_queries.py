"""Telemetry, quality records, usage and billing facts."""

from threadlake.plans.statements import oracle, spark_query

#: Rank floor(n * p / 100), at most n - 1, in order of value. Equal values are counted first, in the tasks, so that the
#: running sums only see different values; an operation of the list that has no rows gives zeros and meets its target.
PERCENTILES = """WITH v AS (SELECT operation, duration_ms, count(*) AS n FROM metrics GROUP BY operation, duration_ms),
    c AS (SELECT operation, duration_ms, sum(n) OVER (PARTITION BY operation ORDER BY duration_ms) - n AS before, n, sum(n) OVER (PARTITION BY operation) AS total FROM v),
    w AS (SELECT operation, duration_ms, before, before + n AS upto, total, CAST(floor(total * 50 / 100) AS BIGINT) AS r50, least(CAST(floor(total * 90 / 100) AS BIGINT), total - 1) AS r90,
          least(CAST(floor(total * 95 / 100) AS BIGINT), total - 1) AS r95, least(CAST(floor(total * 99 / 100) AS BIGINT), total - 1) AS r99 FROM c),
    p AS (SELECT operation, CAST(max(total) AS BIGINT) AS n, min(duration_ms) AS low, max(duration_ms) AS high, max(CASE WHEN r50 >= before AND r50 < upto THEN duration_ms END) AS p50, max(CASE WHEN r90 >= before AND r90 < upto THEN duration_ms END) AS p90,
          max(CASE WHEN r95 >= before AND r95 < upto THEN duration_ms END) AS p95, max(CASE WHEN r99 >= before AND r99 < upto THEN duration_ms END) AS p99 FROM w GROUP BY operation),
    o AS (SELECT 'click' AS operation UNION ALL SELECT 'error' UNION ALL SELECT 'purchase' UNION ALL SELECT 'signup' UNION ALL SELECT 'view' UNION ALL SELECT 'never_seen')
    SELECT o.operation, coalesce(n, 0) AS n, coalesce(low, 0e0) AS low, coalesce(high, 0e0) AS high, coalesce(p50, 0e0) AS p50, coalesce(p90, 0e0) AS p90, coalesce(p95, 0e0) AS p95, coalesce(p99, 0e0) AS p99, coalesce(p90 <= 200, true) AS slo_met
    FROM o LEFT JOIN p ON o.operation = p.operation"""

BODIES = {
    "latency_percentiles": PERCENTILES,
    "metric_summary": "SELECT operation, count(*) AS n, floor(avg(duration_ms) * 10 + 0.5e0) / 10 AS mean, min(duration_ms) AS least, max(duration_ms) AS most FROM metrics GROUP BY operation",
    "metric_window": "WITH newest AS (SELECT max(at_s) AS at_s FROM metrics) SELECT m.id, m.operation FROM metrics m JOIN newest ON m.at_s > newest.at_s - 604800",
    "metric_retention": """SELECT operation, id FROM (SELECT operation, id, row_number() OVER (PARTITION BY operation ORDER BY at_s DESC, id DESC) AS r FROM metrics WHERE at_s > (SELECT max(at_s) - 604800 FROM metrics)) t WHERE r <= 500""",
    "capture_health": """WITH r AS (SELECT id, user_id, operation, row_number() OVER (PARTITION BY user_id ORDER BY at_s DESC, id DESC) AS r FROM metrics)
        SELECT user_id, count(*) AS n, floor(avg(CASE WHEN operation <> 'error' THEN 1e2 ELSE 0e0 END) * 10 + 0.5e0) / 10 AS success,
        count(*) >= 8 AND avg(CASE WHEN operation <> 'error' THEN 1e0 ELSE 0e0 END) < 0.6e0 AS alert FROM r WHERE r <= 20 GROUP BY user_id""",
    "rolling_success": """SELECT id, user_id, round(avg(CASE WHEN operation <> 'error' THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY user_id ORDER BY at_s, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rate FROM metrics""",
    "month_tier_pivot": """SELECT month, count(CASE WHEN id % 3 = 0 THEN 1 END) AS tier1, count(CASE WHEN id % 3 = 1 THEN 1 END) AS tier2, count(CASE WHEN id % 3 = 2 THEN 1 END) AS tier3 FROM metrics GROUP BY month""",
    "usage_counters": """SELECT user_id, month, count(CASE WHEN operation = 'view' THEN 1 END) AS tier1_count, count(CASE WHEN operation = 'click' THEN 1 END) AS tier2_count,
        count(CASE WHEN operation = 'purchase' THEN 1 END) AS tier3_count FROM metrics GROUP BY user_id, month""",
    "usage_reconciled": """WITH a AS (SELECT user_id, month, count(*) AS n FROM metrics WHERE operation = 'view' GROUP BY user_id, month),
        b AS (SELECT user_id, month, count(*) AS n FROM metrics WHERE operation = 'click' GROUP BY user_id, month)
        SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.month, b.month) AS month, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n
        FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.month = b.month""",
    "limits_reached": """WITH u AS (SELECT user_id, month, count(*) AS used FROM metrics WHERE operation = 'purchase' GROUP BY user_id, month)
        SELECT user_id, month, used, used >= 8 AS over_limit, true AS allowed, CASE WHEN used >= 8 THEN 999 ELSE 8 - used END AS remaining FROM u""",
    "user_plans": """WITH latest AS (SELECT user_id, status, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN status = 'F' THEN 1 ELSE 0 END, created_at DESC, id DESC) AS r FROM subscriptions),
        used AS (SELECT user_id, count(*) AS n FROM metrics GROUP BY user_id)
        SELECT u.user_id, coalesce(l.status, 'free') AS plan, coalesce(d.n, 0) AS used FROM users u LEFT JOIN latest l ON u.user_id = l.user_id AND l.r = 1 LEFT JOIN used d ON u.user_id = d.user_id""",
    "admin_stats": """SELECT segment, count(DISTINCT u.user_id) AS users, count(s.id) AS subscriptions, count(CASE WHEN s.status = 'O' THEN 1 END) AS active FROM users u LEFT JOIN subscriptions s ON u.user_id = s.user_id GROUP BY segment""",
    "refund_chain": """SELECT s.id, u.user_id, u.name FROM subscriptions s LEFT JOIN users u ON s.user_id = u.user_id WHERE s.status = 'P'""",
    "quality_recent_average": "SELECT floor(avg(score) * 10 + 0.5e0) / 10 AS average, count(*) AS n FROM (SELECT score FROM quality WHERE score IS NOT NULL ORDER BY created_at DESC LIMIT 50) t",
    "quality_by_tier": "SELECT tier, count(*) AS n, floor(avg(score) * 10 + 0.5e0) / 10 AS average, min(score) AS worst, max(score) AS best FROM quality GROUP BY tier",
    "quality_by_platform": "SELECT platform, count(*) AS n, floor(avg(score) * 10 + 0.5e0) / 10 AS average FROM quality GROUP BY platform",
    "quality_grades": """SELECT CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade, count(*) AS n FROM quality
        GROUP BY CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END""",
    "quality_dimensions": """WITH d AS (SELECT 'survival' AS dimension, avg(survival) / 25e0 AS share FROM quality UNION ALL SELECT 'integrity', avg(integrity) / 20e0 FROM quality UNION ALL SELECT 'freshness', avg(freshness) / 15e0 FROM quality)
        SELECT dimension, round(share, 6) AS share FROM d""",
    "quality_best": "SELECT id, score FROM quality ORDER BY score DESC, id LIMIT 1",
    "rate_limited": """WITH t AS (SELECT user_id, id, at_s, count(*) OVER (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM metrics)
        SELECT user_id, count(CASE WHEN n > 4 THEN 1 END) AS over_limit, max(n) AS most FROM t GROUP BY user_id""",
    "documents_by_language": "SELECT lang, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM texts GROUP BY lang, source",
}

QUERIES = {name: spark_query(body) for name, body in BODIES.items()}
ORACLES = {name: oracle(body) for name, body in BODIES.items()}
