"""Queries over anomaly detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import anomaly as ops
from tallyspark.queries.bars import rounded
from tallyspark.queries.cleaning import votes_sql
from tallyspark.queries.registry import query
from tallyspark.sources import views
from tallyspark.sources.tables import table

KEY, ORDER = ["key"], ["ts", "id"]

_KEYED_SQL = """
s AS (SELECT key, count(value) AS n, avg(value) AS mu, stddev_pop(value) AS sd, kurtosis_pop(value) AS ku, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.5) AS med FROM readings GROUP BY key),
s2 AS (SELECT r.key, avg(power(value - mu, 3)) / nullif(power(avg(power(value - mu, 2)), 1.5), 0) AS sk, quantile_cont(abs(value - med), 0.5) AS mad
  FROM readings r JOIN s ON r.key = s.key GROUP BY r.key),
f AS (SELECT r.id, r.key, value, n, mu, sd, q1, q3, med, mad, sk, ku,
  CASE WHEN n > 100 THEN 3 * CASE WHEN abs(sk) > 1 THEN 1.2 ELSE 1 END * CASE WHEN ku > 3 THEN 1.1 ELSE 1 END ELSE 3 END AS lim
  FROM readings r JOIN s ON r.key = s.key JOIN s2 ON r.key = s2.key),
v AS (SELECT id, key, value, coalesce(n >= 10 AND abs((value - mu) / nullif(sd, 0)) > lim, FALSE) AS z_outlier,
  coalesce(n >= 4 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), FALSE) AS iqr_outlier,
  coalesce(n >= 10 AND mad > 0 AND 0.6745 * abs(value - med) / nullif(mad, 0) > 3.5, FALSE) AS mad_outlier FROM f)
"""


def _values(spark, folder):
    return views.readings(spark, folder).select("id", "key", "value")


@query("D1 D2", views="readings", sql=f"WITH {_KEYED_SQL} SELECT id, key, value, z_outlier FROM v")
def zscore_outliers(spark, folder):
    return ops.zscore_flags(_values(spark, folder), KEY, "value")


@query("D3", views="readings", sql=f"WITH {_KEYED_SQL} SELECT id, key, value, iqr_outlier FROM v")
def iqr_outliers(spark, folder):
    return ops.iqr_flags(_values(spark, folder), KEY, "value")


@query("D4", views="readings", sql=f"WITH {_KEYED_SQL} SELECT id, key, value, mad_outlier FROM v")
def modified_z_outliers(spark, folder):
    return ops.modified_z_flags(_values(spark, folder), KEY, "value")


@query(
    "D2",
    views="readings",
    sql=f"""WITH {_KEYED_SQL} SELECT DISTINCT key, round(CAST(coalesce(lim, 3) AS DOUBLE), 6) AS z_limit FROM f""",
)
def adaptive_limits(spark, folder):
    stats = _values(spark, folder).groupBy("key").agg(
        F.count("value").alias("n"), F.skewness("value").alias("s"), F.kurtosis("value").alias("k")
    )
    limit = F.when(F.col("n") > ops.ADAPTIVE_ABOVE, ops.adaptive_limit(F.col("s"), F.col("k"))).otherwise(3.0)
    return stats.select("key", F.round(limit, 6).alias("z_limit"))


@query(
    "D5",
    views="readings",
    sql=f"WITH {_KEYED_SQL} SELECT id, key, value, z_outlier OR iqr_outlier AS anomaly FROM v",
)
def ensemble_anomalies(spark, folder):
    return ops.detect(_values(spark, folder), KEY, "value")


@query(
    "D5 D1",
    views="readings",
    sql=f"WITH {_KEYED_SQL} SELECT id, key, value, z_outlier AS anomaly FROM v",
)
def statistical_anomalies(spark, folder):
    return ops.detect(_values(spark, folder), KEY, "value", method="statistical")


@query("D6 D1 D3 D4", views="readings", sql=f"WITH {votes_sql('readings', 'value', 'v', 'id, value')} SELECT id, value, votes FROM v")
def outlier_votes(spark, folder):
    rows = views.readings(spark, folder).select("id", "value")
    return ops.outlier_votes(rows, [], "value").select("id", "value", "votes")


_ROBUST_SQL = """
q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM readings)
"""


@query(
    "D11",
    views="readings",
    sql=f"WITH {_ROBUST_SQL} SELECT id, round((value - m) / CASE WHEN b = a THEN 1 ELSE b - a END, 6) AS scaled FROM readings, q",
)
def robust_scaled(spark, folder):
    rows = views.readings(spark, folder).select("id", "value")
    return rounded(ops.robust_scaled(rows, [], "value").drop("value"))


@query(
    "D9",
    sql="""
WITH e AS (SELECT event_id AS id, event_type AS key, value / 40 AS x FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY key ORDER BY x RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) >= 5 AS core FROM e)
SELECT id, key, NOT max(core) OVER (PARTITION BY key ORDER BY x RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS noise FROM c
""",
)
def density_noise(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("key"), (F.col("value") / 40).alias("x")
    )
    return ops.density_noise(rows, KEY, "x").drop("x")


_SERIES_SQL = "series AS (SELECT symbol, ts, close AS value, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"


def _series(spark, folder):
    return views.bars(spark, folder).select("symbol", "ts", F.col("close").alias("value"))


def _seasonal_sql(p):
    h = p // 2
    if p % 2:
        centred = f"sum(value) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    else:
        centred = (
            f"(sum(value) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {h - 1} PRECEDING AND {h - 1} FOLLOWING)"
            f" + 0.5 * (lag(value, {h}) OVER (PARTITION BY symbol ORDER BY i) + lead(value, {h}) OVER (PARTITION BY symbol ORDER BY i)))"
        )
    return f"""
WITH {_SERIES_SQL},
t AS (SELECT *, CASE WHEN i >= {h} AND i < n - {h} THEN {centred} / {p} END AS tr FROM series WHERE n >= 200),
l AS (SELECT symbol, regr_slope(tr, i) FILTER (tr IS NOT NULL AND i < {h + p}) AS k1, regr_intercept(tr, i) FILTER (tr IS NOT NULL AND i < {h + p}) AS c1,
  regr_slope(tr, i) FILTER (tr IS NOT NULL AND i >= n - 1 - {h} - {p} AND i < n - 1 - {h}) AS k2,
  regr_intercept(tr, i) FILTER (tr IS NOT NULL AND i >= n - 1 - {h} - {p} AND i < n - 1 - {h}) AS c2 FROM t GROUP BY symbol),
d AS (SELECT t.symbol, ts, i, value - CASE WHEN tr IS NOT NULL THEN tr WHEN i < {h} THEN k1 * i + c1 ELSE k2 * i + c2 END AS flat FROM t JOIN l ON t.symbol = l.symbol),
p AS (SELECT symbol, i % {p} AS ph, avg(flat) AS s FROM d GROUP BY 1, 2), pl AS (SELECT symbol, avg(s) AS m FROM p GROUP BY 1),
r AS (SELECT d.symbol, ts, flat - (s - m) AS residual FROM d JOIN p ON d.symbol = p.symbol AND d.i % {p} = p.ph JOIN pl ON d.symbol = pl.symbol),
sd AS (SELECT symbol, stddev_samp(residual) AS dev FROM r GROUP BY 1)
SELECT r.symbol, ts, round(residual, 6) AS residual, abs(residual) > 3 * dev AS seasonal_anomaly FROM r JOIN sd ON r.symbol = sd.symbol
"""


@query("D12", views="bars", sql=_seasonal_sql(24))
def seasonal_anomalies_daily(spark, folder):
    return rounded(ops.seasonal_anomalies(_series(spark, folder), ["symbol"], ["ts"], "value", 24).drop("value"))


@query("D12", views="bars", sql=_seasonal_sql(30))
def seasonal_anomalies(spark, folder):
    """Automatic period."""
    return rounded(ops.seasonal_anomalies(_series(spark, folder), ["symbol"], ["ts"], "value").drop("value"))


@query("D12", views="bars", sql=_seasonal_sql(7))
def seasonal_anomalies_odd_period(spark, folder):
    return rounded(ops.seasonal_anomalies(_series(spark, folder), ["symbol"], ["ts"], "value", 7).drop("value"))


_READ_SQL = """series AS (SELECT key, ts, id, full_value AS value, row_number() OVER (PARTITION BY key ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM readings)"""


@query(
    "D13",
    views="readings",
    sql=f"""
WITH {_READ_SQL}, w AS (SELECT *, least(n // 4, 20) AS w FROM series),
f AS (SELECT a.key, a.id, a.value, a.i, a.w, a.n, avg(b.value) AS m, stddev_samp(b.value) AS s, count(*) AS c
  FROM w a JOIN w b ON a.key = b.key AND b.i BETWEEN a.i - a.w + 1 AND a.i GROUP BY ALL)
SELECT series.id, series.key, series.value, coalesce(series.n >= 20 AND c = w AND abs(f.value - m) / (s + 1e-8) > 2.5, FALSE) AS trend_anomaly
FROM series LEFT JOIN f ON series.id = f.id
""",
)
def trend_anomalies(spark, folder):
    rows = views.readings(spark, folder).select("id", "key", "ts", F.col("full_value").alias("value"))
    return ops.trend_anomalies(rows, KEY, ORDER, "value").drop("ts")


_T_LIMITS = ", ".join(f"({w}, {ops.t_limit(2 * w - 2)!r}::DOUBLE)" for w in range(2, 51))


def _change_sql(series, key):
    return f"""
WITH {series}, w AS (SELECT *, least(n // 10, 50) AS w FROM series WHERE n >= 20),
tl AS (SELECT * FROM (VALUES {_T_LIMITS}) x(w, t)),
b AS (SELECT a.{key}, a.i, avg(x.value) AS m, var_samp(x.value) AS v FROM w a JOIN w x ON a.{key} = x.{key} AND x.i BETWEEN a.i - a.w AND a.i - 1 GROUP BY 1, 2),
f AS (SELECT a.{key}, a.i, avg(x.value) AS m, var_samp(x.value) AS v FROM w a JOIN w x ON a.{key} = x.{key} AND x.i BETWEEN a.i AND a.i + a.w - 1 GROUP BY 1, 2)
SELECT w.{key}, w.ts, w.i AS position FROM w JOIN b ON w.{key} = b.{key} AND w.i = b.i JOIN f ON w.{key} = f.{key} AND w.i = f.i JOIN tl ON w.w = tl.w
WHERE w.i >= w.w AND w.i < w.n - w.w AND abs(b.m - f.m) > t * sqrt((b.v + f.v) / w.w)
"""


@query("D14", views="bars", sql=_change_sql(_SERIES_SQL, "symbol"))
def change_points(spark, folder):
    return ops.change_points(_series(spark, folder), ["symbol"], ["ts"], "value").drop("value")


@query("D14", views="readings", sql=_change_sql(_READ_SQL, "key"))
def change_points_short_series(spark, folder):
    rows = views.readings(spark, folder).select("key", "ts", "id", F.col("full_value").alias("value"))
    return ops.change_points(rows, KEY, ORDER, "value").select("key", "ts", "position")


@query(
    "R2 X3",
    views="readings",
    sql="""
WITH r AS (SELECT * FROM (SELECT id, key, value, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS rn FROM readings WHERE value IS NOT NULL) WHERE rn <= 100),
s AS (SELECT key, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM r GROUP BY key)
SELECT r.key, count(*) AS total_points, count(*) FILTER (n >= 4 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) AS anomaly_count
FROM r JOIN s ON r.key = s.key GROUP BY r.key
""",
)
def monitored_streams(spark, folder):
    """Latest 100 readings of each stream, with the IQR detector."""
    rows = views.readings(spark, folder).select("key", "ts", "value")
    return ops.monitor(rows, KEY, "ts", "value", lambda d, k, v: ops.iqr_flags(d, k, v, name="anomaly"))


@query(
    "R3",
    sql="""
WITH c AS (SELECT event_type, ts FROM events WHERE value > 20),
w AS (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL '48 minutes', ts) - INTERVAL 192 MINUTE, time_bucket(INTERVAL '48 minutes', ts), INTERVAL 48 MINUTE)) AS window_start FROM c),
g AS (SELECT event_type, window_start, count(*) AS anomaly_count FROM w GROUP BY 1, 2)
SELECT *, CASE WHEN anomaly_count > 20 THEN 'high' ELSE 'medium' END AS severity FROM g WHERE anomaly_count >= 10
""",
)
def anomaly_alerts(spark, folder):
    """Readings over 20 count as anomalous checks; the window is 4 hours, with the
    same 1:5 slide, because events are minutes apart."""
    checks = table(spark, folder, "events").filter(F.col("value") > 20).select("event_type", "ts")
    out = ops.alerts(checks, "event_type", "ts", window="240 minutes", slide="48 minutes")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
