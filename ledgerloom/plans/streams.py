"""Stream queries: a replay of audit_log and events whose result must equal the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.book import AUDIT_SQL, Book
from ledgerloom.streaming import audit as S

book = Book()


@book.add("st01_daily_actions", "SELECT CAST(logged_at AS DATE) AS day, lower(action_name) AS action, count(*)::BIGINT AS n FROM audit_log WHERE logged_at IS NOT NULL GROUP BY 1, 2")
def _st01(s, d):
    return S.replayed(S.daily_actions(S.stream_of(s, f"{d}/audit_log.parquet")), "complete")


@book.add("st02_first_deliveries", f"WITH {AUDIT_SQL} SELECT log_id, user_id FROM audit")
def _st02(s, d):
    return S.replayed(S.first_deliveries(S.stream_of(s, f"{d}/audit_log.parquet"), "3650 days")).select("log_id", "user_id")


@book.add("st03_alerts", "WITH r(action, severity) AS (VALUES ('fraud_flagged', 'high'), ('exported', 'low')) SELECT log_id, user_id, lower(action_name) AS action, severity FROM audit_log JOIN r ON lower(action_name) = action")
def _st03(s, d):
    rules = s.createDataFrame([("fraud_flagged", "high"), ("exported", "low")], "action string, severity string")
    return S.replayed(S.alerts(S.stream_of(s, f"{d}/audit_log.parquet"), rules))


@book.add("st04_sliding_counts", "WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start_at FROM events) SELECT event_type, start_at AS window_start, count(*)::BIGINT AS n FROM w GROUP BY 1, 2")
def _st04(s, d):
    e = S.stream_of(s, f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    w = e.groupBy("event_type", F.window("at", "2 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return S.replayed(w.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n"), "complete")


@book.add("st05_closed_days", "WITH m AS (SELECT max(logged_at) - INTERVAL 1 HOUR AS mark FROM audit_log) SELECT CAST(logged_at AS DATE) AS day, lower(action_name) AS action, count(*)::BIGINT AS n FROM audit_log, m WHERE CAST(logged_at AS DATE) + INTERVAL 1 DAY <= mark GROUP BY 1, 2")
def _st05(s, d):
    return S.replayed(S.closed_days(S.stream_of(s, f"{d}/audit_log.parquet")))


@book.add("st06_session_windows", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM k GROUP BY user_id, sess")
def _st06(s, d):
    e = S.sessions(S.stream_of(s, f"{d}/events.parquet"))
    return S.replayed(e.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@book.add("st07_upserts", f"WITH {AUDIT_SQL}, r AS (SELECT regexp_extract(claim_id, '([0-9]+)', 1) AS claim, log_id, lower(action_name) AS action, logged_at, row_number() OVER (PARTITION BY regexp_extract(claim_id, '([0-9]+)', 1) ORDER BY logged_at DESC NULLS LAST, log_id DESC) AS k FROM audit WHERE regexp_matches(claim_id, '[0-9]')) SELECT claim, log_id, action FROM r WHERE k = 1")
def _st07(s, d):
    a = S.stream_of(s, f"{d}/audit_log.parquet", maxFilesPerTrigger="4").where(F.col("claim_id").rlike("[0-9]"))
    a = a.select(F.regexp_extract("claim_id", "([0-9]+)", 1).alias("claim"), "log_id", F.lower("action_name").alias("action"), "logged_at")
    return S.upserted(a, ["claim"], ["logged_at", "log_id"]).select("claim", "log_id", "action")


@book.add("st08_overdue_timers", f"WITH {AUDIT_SQL}, m AS (SELECT max(logged_at) - INTERVAL 1 HOUR AS mark FROM audit), c AS (SELECT regexp_extract(claim_id, '([0-9]+)', 1) AS claim, max(logged_at) AS last FROM audit WHERE logged_at IS NOT NULL AND regexp_matches(claim_id, '[0-9]') GROUP BY 1) SELECT claim FROM c, m WHERE last + INTERVAL 30 DAY <= mark")
def _st08(s, d):
    """Timers of a stream that comes in one batch: those before the watermark at its end have fired."""
    return S.replayed(S.overdue(S.stream_of(s, f"{d}/audit_log.parquet"))).select("claim")
