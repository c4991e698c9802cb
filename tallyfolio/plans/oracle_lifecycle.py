"""The same results in DuckDB's SQL: job logs, stored rows, streams."""
from __future__ import annotations

from tallyfolio.plans.oracle_documents import usable

AS_OF, NOW = "TIMESTAMP '2024-01-15 12:00:00'", "TIMESTAMP '2024-02-01 00:00:00'"
COLUMNS = ("status", "was_scan", "source_path", "tier_used", "error")


def shown(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def folded(where: str) -> str:
    last = ", ".join(f"arg_max({c}, (ts, seq)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in COLUMNS)
    return (f"SELECT job_id, min(ts) AS created_at, max(ts) AS updated_at, {last} FROM changes "
            f"WHERE {where} GROUP BY job_id")


def flat(source: str, where: str = "true") -> str:
    return f"""SELECT job_id, {shown('created_at')} AS created_at, {shown('updated_at')} AS updated_at,
        coalesce(status.v, '') AS status, coalesce(was_scan.v, '') AS was_scan, coalesce(source_path.v, '') AS source_path,
        coalesce(tier_used.v, '') AS tier_used, coalesce(error.v, '') AS error FROM ({source}) WHERE {where}"""


CTES = {
    "job_log": """
        SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS job_id, user_id, ts, event_id AS seq, event_type, value,
               CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED'
                    WHEN 'error' THEN 'FAILED' END AS status FROM events""",
    "changes": """
        SELECT job_id, ts, seq, CASE WHEN event_type <> 'click' THEN {'v': status} END AS status,
               CASE WHEN event_type = 'click' THEN {'v': (value > 20)::VARCHAR} END AS was_scan,
               CASE WHEN event_type = 'click' THEN {'v': '/documents/' || job_id || '/' || seq} END AS source_path,
               CASE event_type WHEN 'purchase' THEN {'v': CASE WHEN value > 30 THEN 'tier-2' ELSE 'tier-1' END}
                    WHEN 'error' THEN {'v': NULL::VARCHAR} END AS tier_used,
               CASE event_type WHEN 'error' THEN {'v': 'event ' || seq}
                    WHEN 'purchase' THEN {'v': NULL::VARCHAR} END AS error
        FROM job_log""",
    "flushed": """
        SELECT *, '/documents/' || id || '/statement_' || seq || '.pdf' AS path
        FROM (SELECT job_id || '-' || seq AS id, seq, ts, event_type, status FROM job_log
              WHERE status IN ('SUCCEEDED', 'FAILED'))""",
    "newest_live": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn
                       FROM job_log WHERE user_id % 2 = 0) WHERE rn = 1""",
    "newest_durable": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn
                       FROM job_log WHERE (user_id % 2 = 1 OR user_id % 10 = 0) AND ts <= {AS_OF}) WHERE rn = 1""",
}

def asked_column(c: str) -> str:
    """A column's last write at or before each question, by an as-of join."""
    return f"""a_{c} AS (
        SELECT q.job_id, q.seq, w.w.v AS {c} FROM asked q ASOF LEFT JOIN (
            SELECT job_id, ts, arg_max({c}, seq) AS w FROM changes WHERE {c} IS NOT NULL GROUP BY job_id, ts) w
        ON q.job_id = w.job_id AND q.moment >= w.ts)"""


ORACLE = {
    "claim_history": f"""
        SELECT job_id, coalesce(w.v, '') AS status, {shown('ts')} AS valid_from, coalesce({shown('following')}, '') AS valid_to
        FROM (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts) AS following
              FROM (SELECT *, lag(w) OVER (PARTITION BY job_id ORDER BY ts) AS previous
                    FROM (SELECT job_id, ts, arg_max(status, seq) AS w FROM changes WHERE status IS NOT NULL GROUP BY job_id, ts))
              WHERE previous IS NULL OR previous.v IS DISTINCT FROM w.v)""",
    "claim_states_asked": f"""
        SELECT * FROM (WITH asked AS (
            SELECT unnest([job_id, user_id || '-' || strftime(ts - INTERVAL 1 DAY, '%Y%m%d')]) AS job_id, seq, ts + INTERVAL 90 MINUTE AS moment
            FROM job_log WHERE seq % 5 = 0), {', '.join(map(asked_column, COLUMNS))}
        SELECT job_id, seq, {shown('moment')} AS moment, {', '.join(f"coalesce({c}, '') AS {c}" for c in COLUMNS)}
        FROM asked {' '.join(f'JOIN a_{c} USING (job_id, seq)' for c in COLUMNS)})""",
    "job_state": flat(folded("true")),
    "job_state_as_of": flat(folded(f"ts <= {AS_OF}")),
    "job_partial_update": flat(f"""
        SELECT b.job_id, b.created_at, CASE WHEN u.job_id IS NULL THEN b.updated_at ELSE {NOW} END AS updated_at, """ +
        ", ".join(f"coalesce(u.{c}, b.{c}) AS {c}" for c in COLUMNS) +
        f" FROM ({folded(f'ts <= {AS_OF}')}) b LEFT JOIN ({folded(f'ts > {AS_OF}')}) u USING (job_id)"),
    "job_latest_rows": f"""
        SELECT job_id, status, {shown('ts')} AS updated_at, seq FROM (
            SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn
            FROM job_log WHERE event_type <> 'click') WHERE rn = 1""",
    "terminal_jobs": flat(folded("true"), "status.v IN ('SUCCEEDED', 'FAILED')"),
    "stale_jobs": f"""
        SELECT job_id, {shown('updated_at')} AS updated_at,
               ((epoch({NOW})::BIGINT - floor(epoch(updated_at))::BIGINT) // 60)::BIGINT AS idle_minutes
        FROM ({folded('true')}) WHERE status.v = 'RUNNING' AND epoch({NOW}) - floor(epoch(updated_at)) > 86400""",
    "job_overlay": f"""
        SELECT job_id, {shown('ts')} AS ts, seq, event_type, store FROM (
            SELECT job_id, ts, seq, event_type, 'live' AS store FROM newest_live
            UNION ALL SELECT job_id, ts, seq, event_type, 'durable' FROM newest_durable
            WHERE job_id NOT IN (SELECT job_id FROM newest_live))""",
    "trail_overlay": f"""
        SELECT job_id, seq, {shown('ts')} AS ts, event_type,
               CASE WHEN user_id % 2 = 0 THEN 'live' ELSE 'durable' END AS store FROM job_log""",
    "known_job_events": """
        SELECT job_id, seq, event_type FROM job_log
        WHERE job_id IN (SELECT job_id FROM job_log WHERE event_type = 'signup')""",
    "trails_oldest_first": f"""
        SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS position, {shown('ts')} AS ts, seq,
               event_type FROM job_log""",
    "lifecycle_violations": """
        SELECT job_id, seq, coalesce(previous, '') AS previous, status FROM (
            SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS previous
            FROM job_log WHERE event_type <> 'click')
        WHERE NOT (CASE WHEN previous IS NULL THEN status = 'PENDING' ELSE previous = status
                   OR (previous = 'PENDING' AND status = 'RUNNING')
                   OR (previous = 'RUNNING' AND status IN ('SUCCEEDED', 'FAILED')) END)""",
    "new_job_rows": f"""
        SELECT job_id AS id, 'PENDING' AS status, coalesce(filename, '') AS filename, {shown(NOW)} AS created_at FROM submissions""",
    "received_events": f"""
        SELECT sha256(job_id || '|' || {shown(NOW)} || '|RECEIVED|0') AS event_id, job_id, 0::BIGINT AS seq, {shown(NOW)} AS ts,
               'RECEIVED' AS stage, 'job created for ' || coalesce('''' || filename || '''', 'None') AS detail FROM submissions""",
    "appended_events": f"""
        SELECT sha256(job_id || '|' || {shown(NOW)} || '|' || stage || '|0') AS event_id, job_id, 0::BIGINT AS seq, stage, detail
        FROM (SELECT job_id, 'RECEIVED' AS stage, 'job created for ' || coalesce('''' || filename || '''', 'None') AS detail FROM submissions
              UNION ALL SELECT job_id, 'PAGES', n_images::VARCHAR FROM submissions WHERE n_images > 0)""",
    "job_by_id": "SELECT * FROM flat_jobs WHERE job_id = (SELECT max(job_id) FROM submissions)",
    "trail_by_id": f"""
        SELECT {shown(NOW)} AS ts, 0::BIGINT AS seq, 'RECEIVED' AS stage,
               'job created for ' || coalesce('''' || filename || '''', 'None') AS detail
        FROM submissions WHERE job_id = (SELECT max(job_id) FROM submissions)""",
    "stored_jobs": """
        SELECT job_id AS id, status, coalesce(rec.number, '') AS number, rec.total AS total,
               coalesce(rec.items[1].d, '') AS first_item, warn IS NULL AS no_warnings, coalesce(warn, '') AS warning
        FROM outcomes""",
    "loaded_jobs": "SELECT * FROM flat_jobs",
    "job_lookup": """
        SELECT job_id, filename IS NULL AS unnamed FROM submissions WHERE n_images = 2 AND NOT has_text""",
    "stream_routing": f"""
        SELECT d.doc_id, CASE WHEN has_text THEN 'text' ELSE 'vision' END AS reader, NOT has_text AS was_scan,
               CASE WHEN has_text THEN 0 ELSE n END::BIGINT AS n_images
        FROM (SELECT doc_id, {usable('text', 0.6)} AS has_text FROM documents) d
        JOIN (SELECT doc_id, count(*) AS n FROM page_choice WHERE ink > 0.002 OR (n_inked = 0 AND rn = 1)
              GROUP BY doc_id) i USING (doc_id)""",
    "stream_unique_events": "SELECT event_id, event_type, user_id FROM events",
    "stream_live_status": f"""
        SELECT job_id, status, {shown('ts')} AS ts, seq, n_events FROM (
            SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn,
                   count(*) OVER (PARTITION BY job_id) AS n_events
            FROM job_log WHERE event_type <> 'click') WHERE rn = 1""",
    "stream_requeued_jobs": f"""
        SELECT job_id, {shown('ts')} AS running_since, seq FROM (
            SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) AS following FROM job_log WHERE event_type <> 'click')
        WHERE status = 'RUNNING' AND epoch_ms(ts) + 21600000 < coalesce(epoch_ms(following), (SELECT max(epoch_ms(ts)) - 3600000 + 1 FROM job_log
                                                                                             WHERE event_type <> 'click'))""",
    "stream_final_flush": f"""
        SELECT 'documents' AS sink, id AS key, path AS value FROM flushed
        UNION ALL SELECT 'jobs', id, status || '|' || path || '|false|-|["' || event_type || '"]' FROM flushed
        UNION ALL SELECT 'audit_events', sha256(id || '|' || {shown('ts')} || '|RECEIVED|0'), id || '|0|RECEIVED|' FROM flushed
        UNION ALL SELECT 'audit_events', sha256(id || '|' || {shown('ts')} || '|' || upper(event_type) || '|1'),
               id || '|1|' || upper(event_type) || '|' || event_type FROM flushed""",
}
