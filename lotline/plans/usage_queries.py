"""Registered usage / quota queries (survey 2.5 usage rows, 2.9 batch forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotline.operators import usage
from lotline.plans import bindings as B
from lotline.plans.registry import register

_U = B.with_ctes(B.USAGE_SQL)
_COUNTERS = """, counters AS (SELECT user_id, CAST(ts AS DATE) AS period_date, count(*) AS call_count FROM usage GROUP BY ALL),
today AS (SELECT CAST(max(ts) AS DATE) AS d FROM usage)
"""
_LIMIT_SQL = "CASE role WHEN 'user' THEN 10 WHEN 'paid' THEN 200 WHEN 'admin' THEN NULL ELSE 10 END"


def _counters(spark, sf):
    u = B.usage_events(spark, sf)
    return u, usage.daily_counter(u), F.to_date(u.select(F.max("ts")).scalar())


@register("daily_counter", _U + _COUNTERS + "SELECT * FROM counters")
def q_daily_counter(spark, sf):
    return usage.daily_counter(B.usage_events(spark, sf))


@register(
    "usage_overview",
    _U + _COUNTERS + """SELECT CAST(COALESCE(sum(call_count) FILTER (WHERE period_date = d), 0) AS BIGINT) AS today_total,
  count(*) FILTER (WHERE period_date = d AND call_count > 0) AS active_users_today,
  CAST(COALESCE(sum(call_count) FILTER (WHERE period_date BETWEEN d - 6 AND d), 0) AS BIGINT) AS week_total,
  CAST(COALESCE(sum(call_count) FILTER (WHERE period_date BETWEEN date_trunc('month', d) AND d), 0) AS BIGINT) AS month_to_date,
  strftime(d, '%Y-%m') AS month_label, 100000 AS monthly_cap, 10 AS quota_user_per_day, 200 AS quota_paid_per_day,
  (SELECT count(*) FROM (SELECT DISTINCT user_id FROM usage)) AS profiles_count, (SELECT count(*) FROM orders) AS properties_count
FROM counters, today GROUP BY d""",
)
def q_usage_overview(spark, sf):
    u, c, today = _counters(spark, sf)
    return usage.usage_overview(c, today, {"profiles": u.select("user_id").distinct(), "properties": B.table(spark, sf, "orders")})


@register(
    "usage_by_day",
    _U + _COUNTERS + "SELECT period_date, CAST(sum(call_count) AS BIGINT) AS total_calls FROM counters, today WHERE period_date BETWEEN d - 6 AND d GROUP BY period_date",
)
def q_usage_by_day(spark, sf):
    _, c, today = _counters(spark, sf)
    return usage.usage_by_day(c, today)


@register(
    "monthly_total_cap",
    _U + _COUNTERS + """SELECT CAST(date_trunc('month', period_date) AS DATE) AS month, CAST(sum(call_count) AS BIGINT) AS month_total,
  100000 AS cap, sum(call_count) >= 100000 AS cap_reached FROM counters GROUP BY 1""",
)
def q_monthly_total_cap(spark, sf):
    _, c, _ = _counters(spark, sf)
    return usage.monthly_total_cap(c)


@register(
    "quota_status",
    _U + _COUNTERS + f""", users AS (SELECT DISTINCT user_id, role FROM usage)
SELECT u.user_id, u.role, CAST({_LIMIT_SQL} AS INTEGER) AS daily_limit,
  CASE WHEN {_LIMIT_SQL} IS NULL THEN 0 ELSE COALESCE(c.call_count, 0) END AS used_today,
  CASE WHEN {_LIMIT_SQL} IS NOT NULL THEN greatest(0, {_LIMIT_SQL} - COALESCE(c.call_count, 0)) END AS remaining,
  t.d + 1 AS resets_at
FROM users u CROSS JOIN today t LEFT JOIN counters c ON c.user_id = u.user_id AND c.period_date = t.d""",
)
def q_quota_status(spark, sf):
    u, c, today = _counters(spark, sf)
    users = u.select("user_id", "role").distinct()
    return usage.quota_status(users, c, today)


QUOTA_ADMISSION_SQL = _U + f""", r AS (
  SELECT *, CAST(ts AS DATE) AS period_date,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM usage)
SELECT user_id, event_id, ts, period_date, role,
  ({_LIMIT_SQL}) IS NULL OR rn <= {_LIMIT_SQL} AS admitted,
  CASE WHEN ({_LIMIT_SQL}) IS NULL OR rn <= {_LIMIT_SQL} THEN 'ok' ELSE 'quota_exhausted' END AS reason
FROM r"""


@register("quota_admission", QUOTA_ADMISSION_SQL)
def q_quota_admission(spark, sf):
    return usage.quota_admission(B.usage_events(spark, sf))


def _cap_sql(cap: int) -> str:
    return _U + f""", r AS (SELECT event_id, ts, row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id) AS rn FROM usage)
SELECT event_id, ts, rn <= {cap} AS admitted FROM r"""


@register("monthly_cap_admission", _cap_sql(usage.MONTHLY_CAP))
def q_monthly_cap_admission(spark, sf):
    return usage.monthly_cap_admission(B.usage_events(spark, sf))


@register("monthly_cap_admission_cap5000", _cap_sql(5000))
def q_monthly_cap_admission_small(spark, sf):
    return usage.monthly_cap_admission(B.usage_events(spark, sf), cap=5000)


@register("stream_daily_counter", _U + _COUNTERS + "SELECT * FROM counters")
def q_stream_daily_counter(spark, sf):
    from lotline.streaming.counters import run_daily_counter
    return run_daily_counter(spark, sf)


@register("stream_quota_admission", QUOTA_ADMISSION_SQL)
def q_stream_quota_admission(spark, sf):
    from lotline.streaming.counters import run_quota_admission
    return run_quota_admission(spark, sf)
