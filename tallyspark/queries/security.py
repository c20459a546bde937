"""Queries over login and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import folds, security
from tallyspark.queries.bars import rounded
from tallyspark.queries.registry import query
from tallyspark.sources import views
from tallyspark.sources.tables import table


def _counter_sql(src, key, seconds, out):
    return f"""
{out}_a AS (SELECT id, {key}, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL {seconds} SECOND THEN 1 ELSE 0 END AS s FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY ts, id)),
{out}_b AS (SELECT id, {key}, ts, sum(s) OVER (PARTITION BY {key} ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS sess FROM {out}_a),
{out} AS (SELECT id, row_number() OVER (PARTITION BY {key}, sess ORDER BY ts, id) AS n FROM {out}_b)"""


RISK_SQL = f"""
WITH fl AS (SELECT * FROM logins WHERE NOT success), {_counter_sql("fl", "user_id", 3600, "f")}, {_counter_sql("logins", "ip", 300, "a")},
ki AS (SELECT user_id, ip, min(ts) AS t FROM logins WHERE success GROUP BY 1, 2), ka AS (SELECT user_id, agent, min(ts) AS t FROM logins WHERE success GROUP BY 1, 2),
j AS (SELECT l.*, f.n AS failed_count, a.n AS attempt_count, coalesce(ki.t < l.ts, FALSE) AS known_address, coalesce(ka.t < l.ts, FALSE) AS known_agent
  FROM logins l LEFT JOIN f ON l.id = f.id JOIN a ON l.id = a.id LEFT JOIN ki ON l.user_id = ki.user_id AND l.ip = ki.ip LEFT JOIN ka ON l.user_id = ka.user_id AND l.agent = ka.agent),
risk AS (SELECT *, CAST(least(100, CASE WHEN failed_count > 5 THEN 50 ELSE 0 END + CASE WHEN known_address THEN 0 ELSE 30 END + CASE WHEN known_agent THEN 0 ELSE 20 END
  + CASE WHEN attempt_count > 10 THEN 40 ELSE 0 END) AS INTEGER) AS risk FROM j)
"""


@query(
    "R5",
    views="logins",
    sql=f"{RISK_SQL} SELECT id, user_id, ip, failed_count, attempt_count, known_address, known_agent, risk FROM risk",
)
def login_risk(spark, folder):
    """The log spans less than the life of the known sets, so the SQL needs no expiry."""
    out = security.login_risk(views.logins(spark, folder))
    return out.select("id", "user_id", "ip", "failed_count", "attempt_count", "known_address", "known_agent", "risk")


@query(
    "R8",
    views="logins",
    sql=f"""{RISK_SQL} SELECT user_id, 'login_attempt' AS action, success, ip AS ip_address, ts AS at, risk AS risk_score,
 '{{"agent":"' || agent || '","known_address":' || known_address || ',"known_agent":' || known_agent || '}}' AS details FROM risk""",
)
def audit_log(spark, folder):
    return security.audit_log(security.login_risk(views.logins(spark, folder)))


@query(
    "R6",
    views="logins",
    sql="""
WITH g AS (SELECT id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 7 DAY THEN 1 ELSE 0 END AS s FROM logins WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS sess, CAST(hour(ts) AS INTEGER) AS hour FROM g),
m AS (SELECT *, avg(hour) OVER (PARTITION BY user_id, sess ORDER BY ts, id ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS mean_hour FROM h)
SELECT id, user_id, ts, hour, round(mean_hour, 9) AS mean_hour, abs(hour - mean_hour) > 6 AS unusual FROM m
""",
)
def unusual_hours(spark, folder):
    return rounded(security.unusual_hours(views.logins(spark, folder).select("id", "user_id", "ts")), digits=9)


@query(
    "R8",
    views="logins",
    sql="""
WITH s AS (SELECT id, user_id, ts AS created_at, ts + to_minutes(CAST(30 + id % 400 AS BIGINT)) AS expires_at FROM logins WHERE success)
SELECT id, user_id, created_at, expires_at FROM s WHERE expires_at > TIMESTAMP '2024-01-15 12:00:00' AND created_at <= TIMESTAMP '2024-01-15 12:00:00'
""",
)
def active_sessions(spark, folder):
    return security.active_sessions(_sessions(spark, folder), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


def _sessions(spark, folder):
    life = F.make_dt_interval(mins=(30 + F.col("id") % 400).cast("int"))
    return (
        views.logins(spark, folder)
        .filter("success")
        .select("id", "user_id", F.col("ts").alias("created_at"), (F.col("ts") + life).alias("expires_at"))
    )


@query(
    "R8",
    views="logins",
    sql="""
WITH s AS (SELECT id, user_id, ts AS created_at, ts + to_minutes(CAST(30 + id % 400 AS BIGINT)) AS expires_at FROM logins WHERE success),
e AS (SELECT user_id, created_at AS moment, 1 AS step, id FROM s UNION ALL SELECT user_id, expires_at, -1, id FROM s),
o AS (SELECT user_id, sum(step) OVER (PARTITION BY user_id ORDER BY moment, step, id ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, max(n)::BIGINT AS most_open, max(n) > 3 AS over_limit FROM o GROUP BY 1
""",
)
def concurrent_sessions(spark, folder):
    return security.concurrent_sessions(_sessions(spark, folder))


def hold_sql(src, key, failures, seconds):
    """Failure blocks as a recursion over the rows of each key."""
    live = "(h.until IS NULL OR r.ts >= h.until)"
    return f"""
r AS (SELECT id, {key}, ts, success, row_number() OVER (PARTITION BY {key} ORDER BY ts, id) AS i FROM {src}),
h({key}, i, id, ignored, failures, until) AS (
  SELECT DISTINCT {key}, 0::BIGINT, NULL::BIGINT, FALSE, 0::BIGINT, NULL::TIMESTAMP FROM r
  UNION ALL
  SELECT r.{key}, r.i, r.id, NOT {live},
    CASE WHEN NOT {live} THEN h.failures WHEN r.success THEN 0 ELSE h.failures + 1 END,
    CASE WHEN NOT {live} THEN h.until WHEN r.success THEN NULL WHEN h.failures + 1 >= {failures} THEN r.ts + INTERVAL {seconds} SECOND ELSE NULL END
  FROM h JOIN r ON r.{key} = h.{key} AND r.i = h.i + 1)
"""


def limit_sql(src, key, requests, burst, seconds):
    """Renewing counters as a recursion over the rows of each key."""
    count = "(CASE WHEN h.until IS NOT NULL AND r.ts >= h.until THEN 0 ELSE h.n END)"
    size = max(requests, burst)
    return f"""
r AS (SELECT id, {key}, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts, id) AS i FROM {src}),
h({key}, i, id, allowed, remaining, n, until) AS (
  SELECT DISTINCT {key}, 0::BIGINT, NULL::BIGINT, FALSE, 0::BIGINT, 0::BIGINT, NULL::TIMESTAMP FROM r
  UNION ALL
  SELECT r.{key}, r.i, r.id, {count} < {size},
    CASE WHEN {count} < {requests} THEN {requests} - {count} - 1 WHEN {count} < {size} THEN {burst} - {count} - 1 ELSE 0 END,
    CASE WHEN {count} < {size} THEN {count} + 1 ELSE {count} END,
    CASE WHEN {count} < {size} THEN r.ts + INTERVAL {seconds} SECOND ELSE h.until END
  FROM h JOIN r ON r.{key} = h.{key} AND r.i = h.i + 1)
"""


LOCKOUT_SQL = (
    f"WITH RECURSIVE {hold_sql('logins', 'user_id', 5, 1800)} SELECT id, user_id, ignored, failures, "
    "coalesce(epoch_us(until), -1) AS blocked_until FROM h WHERE id IS NOT NULL"
)
LIMIT_SQL = (
    f"WITH RECURSIVE l AS (SELECT id, ip AS client, ts FROM logins), {limit_sql('l', 'client', 20, 25, 3600)} "
    "SELECT id, client, allowed, remaining FROM h WHERE id IS NOT NULL"
)


def request_sql(closed=""):
    return (
        "SELECT ip AS client, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests, "
        f"count(*) > {security.REQUESTS} AS over_limit, count(*) > {security.BURST} AS over_burst FROM logins GROUP BY 1, 2 {closed}"
    )


@query("R7", views="logins", sql=LOCKOUT_SQL)
def lockouts(spark, folder):
    out = folds.lockouts(views.logins(spark, folder).select("id", "user_id", "ts", "success"))
    return out.drop("ts", "success")


@query("R9", views="logins", sql=request_sql())
def requests_per_hour(spark, folder):
    """Requests of each address per hour, and which hours pass the limit."""
    return security.request_counts(views.logins(spark, folder).select(F.col("ip").alias("client"), "ts"))


@query(
    "R10",
    sql="""
WITH c AS (SELECT event_type AS endpoint, value < 60 AS failed, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE for i in range(4)]) AS window_start FROM events)
SELECT endpoint, window_start, count(*) AS calls, count(*) FILTER (failed) AS failures, count(*) FILTER (failed) / count(*)::DOUBLE AS error_share FROM c GROUP BY 1, 2
""",
)
def endpoint_error_shares(spark, folder):
    """Error share of each endpoint over sliding hours."""
    calls = table(spark, folder, "events").select(F.col("event_type").alias("endpoint"), "ts", (F.col("value") >= 60).alias("success"))
    return security.endpoint_errors(calls)


@query("R9", views="logins", sql=LIMIT_SQL)
def rate_limits(spark, folder):
    """Each address may make 20 requests, 25 in bursts, per renewing hour."""
    requests = views.logins(spark, folder).select("id", F.col("ip").alias("client"), "ts")
    return folds.rate_limited(requests, folds.Limit(requests=20, burst=25, seconds=3600)).drop("ts")


@query(
    "R10",
    sql=f"""
WITH RECURSIVE calls AS (SELECT event_id AS id, event_type AS endpoint, ts, value >= 60 AS success FROM events), {hold_sql("calls", "endpoint", 5, 60)},
s AS (SELECT r.endpoint, r.ts, r.id, CASE WHEN h.until IS NULL THEN 'closed' ELSE 'open' END AS state FROM h JOIN r ON h.id = r.id),
b AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS e FROM s WINDOW w AS (PARTITION BY endpoint ORDER BY ts, id)),
k AS (SELECT *, sum(e) OVER (PARTITION BY endpoint ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS interval_no FROM b)
SELECT endpoint, CAST(interval_no AS BIGINT) AS "interval", any_value(state) AS state, min(ts) AS started_at, max(ts) AS last_call, count(*) AS calls FROM k GROUP BY 1, 2
""",
)
def endpoint_health(spark, folder):
    calls = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("endpoint"),
        "ts",
        (F.col("value") >= 60).alias("success"),
    )
    return folds.state_intervals(folds.endpoint_states(calls))
