"""Queries over bars and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import bars as ops
from tallyspark.queries.registry import query
from tallyspark.sources import views
from tallyspark.sources.tables import table


def rounded(df, *skip, digits=6):
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.round(c, digits) for c in df.columns if kinds[c] == "double" and c not in skip})


def _resample_sql(days, bucket):
    return (
        f"SELECT event_type AS symbol, {bucket} AS bar_start, arg_min(value, ts) AS open, max(value) AS high, "
        f"min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2"
    )


def _resample(days):
    def run(spark, folder):
        ticks = table(spark, folder, "events").select(F.col("event_type").alias("symbol"), "ts", "value")
        out = ops.resample(ticks, ops.interval_for_days(days))
        return out.withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))

    return run


for _days, _name, _bucket in [
    (1, "bars_5_minutes", "time_bucket(INTERVAL '5 minutes', ts)"),
    (7, "bars_1_hour", "time_bucket(INTERVAL '1 hour', ts)"),
    (30, "bars_2_hours", "time_bucket(INTERVAL '2 hours', ts)"),
    (90, "bars_6_hours", "time_bucket(INTERVAL '6 hours', ts)"),
    (365, "bars_1_day", "time_bucket(INTERVAL '1 day', ts)"),
]:
    _run = _resample(_days)
    _run.__name__ = _name
    query("S18", sql=_resample_sql(_days, _bucket))(_run)


@query(
    "P26 P27 T5",
    views="bars",
    sql="""
SELECT symbol, ts, round(high - low, 6) AS price_range, round(close - open, 6) AS price_change,
       round((close - open) / nullif(open, 0), 6) AS price_change_pct,
       round((high - low) / nullif(close, 0), 6) AS high_low_pct,
       CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month,
       CAST(quarter(ts) AS INTEGER) AS quarter, CASE WHEN day(ts) > 25 THEN 1 ELSE 0 END AS is_month_end
FROM bars
""",
)
def bar_features(spark, folder):
    out = ops.calendar_features(ops.price_features(views.bars(spark, folder)))
    out = rounded(out).drop("open", "high", "low", "close", "volume")
    return out.repartition("symbol").sortWithinPartitions("symbol", "ts")


def _frame(n):
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(expr, n):
    return f"CASE WHEN count(*) {_frame(n)} = {n} THEN round({expr} {_frame(n)}, 6) END"


@query(
    "W2",
    views="bars",
    sql="SELECT symbol, ts, "
    + ", ".join(
        f"{_full('avg(close)', n)} AS sma_{n}, {_full('stddev_samp(close)', n)} AS volatility_{n}, {_full('avg(volume)', n)} AS volume_sma_{n}"
        for n in (3, 5, 10)
    )
    + " FROM bars",
)
def moving_averages(spark, folder):
    out = ops.indicators(views.bars(spark, folder), ops.moving_columns, before=9)
    return rounded(out.drop("open", "high", "low", "close", "volume"))


@query(
    "W3",
    views="bars",
    sql="SELECT symbol, ts, "
    + ", ".join(
        f"round(avg(close) {_frame(n)}, 6) AS short_sma_{n}, round(coalesce(stddev_samp(close) {_frame(n)}, 0), 6) AS short_volatility_{n}"
        for n in (3, 5)
    )
    + " FROM bars",
)
def short_moving_averages(spark, folder):
    out = ops.indicators(views.bars(spark, folder), ops.short_moving_columns, before=4)
    return rounded(out.drop("open", "high", "low", "close", "volume"))


@query(
    "W8",
    views="bars",
    sql=f"""
WITH b AS (SELECT symbol, ts, close,
  CASE WHEN count(*) {_frame(20)} = 20 THEN avg(close) {_frame(20)} END AS m,
  CASE WHEN count(*) {_frame(20)} = 20 THEN stddev_samp(close) {_frame(20)} END AS s FROM bars)
SELECT symbol, ts, round(m, 6) AS bb_middle, round(m + 2 * s, 6) AS bb_upper, round(m - 2 * s, 6) AS bb_lower,
       round((close - (m - 2 * s)) / nullif(4 * s, 0), 6) AS bb_position FROM b
""",
)
def bollinger_bands(spark, folder):
    out = ops.indicators(views.bars(spark, folder), ops.bollinger_columns, before=19)
    return rounded(out.drop("open", "high", "low", "close", "volume"))


@query(
    "W6 W7",
    views="bars",
    sql=f"""
WITH d AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS m FROM bars),
g AS (SELECT symbol, ts, CASE WHEN m > 0 THEN m ELSE 0 END AS gain, CASE WHEN m < 0 THEN -m ELSE 0 END AS loss FROM d),
a AS (SELECT symbol, ts, count(*) {_frame(7)} AS n, avg(gain) {_frame(7)} AS g7, avg(loss) {_frame(7)} AS l7,
             avg(gain) {_frame(5)} AS g5, avg(loss) {_frame(5)} AS l5 FROM g)
SELECT symbol, ts, round(CASE WHEN n < 7 THEN NULL WHEN l7 > 0 THEN 100 - 100 / (1 + g7 / l7) WHEN g7 > 0 THEN 100 END, 6) AS rsi_7,
       round(100 - 100 / (1 + g5 / (l5 + 1e-8)), 4) AS rsi_5 FROM a
""",
)
def relative_strength(spark, folder):
    out = ops.rsi(views.bars(spark, folder)).drop("open", "high", "low", "close", "volume")
    return out.withColumns({"rsi_7": F.round("rsi_7", 6), "rsi_5": F.round("rsi_5", 4)})


_KEYORDER = "OVER (PARTITION BY symbol ORDER BY ts)"


@query(
    "W9",
    views="bars",
    sql="SELECT symbol, ts, "
    + ", ".join(
        f"lag(close, {n}) {_KEYORDER} AS close_lag_{n}, lag(volume, {n}) {_KEYORDER} AS volume_lag_{n}, "
        f"round(lag(close - open, {n}) {_KEYORDER}, 6) AS price_change_lag_{n}"
        for n in (1, 3, 5, 10)
    )
    + " FROM bars",
)
def lagged_bars(spark, folder):
    out = ops.indicators(views.bars(spark, folder), ops.lag_columns, before=10)
    return rounded(out.drop("open", "high", "low", "close", "volume"))


def _targets_sql(ahead):
    return f"""
SELECT symbol, ts, round(lead(close, {ahead}) {_KEYORDER}, 6) AS target,
       round((lead(close, {ahead}) {_KEYORDER} - close) / nullif(close, 0), 6) AS target_return,
       CASE WHEN lead(close) {_KEYORDER} > close THEN 1 ELSE 0 END AS direction,
       round((close - lag(close) {_KEYORDER}) / nullif(lag(close) {_KEYORDER}, 0), 6) AS returns,
       round(close - lag(close) {_KEYORDER}, 6) AS change FROM bars
"""


@query("W10", views="bars", sql=_targets_sql(5))
def price_targets(spark, folder):
    out = ops.indicators(views.bars(spark, folder), lambda w: ops.target_columns(w, 5), before=1, after=5)
    return rounded(out.drop("open", "high", "low", "close", "volume"))


@query("W10", views="bars", sql=_targets_sql(30))
def price_targets_30(spark, folder):
    out = ops.indicators(views.bars(spark, folder), lambda w: ops.target_columns(w, 30), before=1, after=30)
    return rounded(out.drop("open", "high", "low", "close", "volume"))


def _ema_cte(name, src, col, span, reach):
    keep = f"(1 - 2.0 / {span + 1})"
    return (
        f"{name} AS (SELECT a.symbol, a.i, sum(b.{col} * power({keep}::DOUBLE, a.i - b.i)) / sum(power({keep}::DOUBLE, a.i - b.i)) AS v "
        f"FROM {src} a JOIN {src} b ON a.symbol = b.symbol AND b.i BETWEEN a.i - {reach} AND a.i GROUP BY 1, 2)"
    )


@query(
    "W4 W5",
    views="bars",
    sql="WITH n AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars), "
    + ", ".join(_ema_cte(f"e{s}", "n", "close", s, r) for s, r in [(3, 60), (5, 100), (10, 200), (12, 240), (26, 520)])
    + ", m AS (SELECT e12.symbol, e12.i, e12.v - e26.v AS v FROM e12 JOIN e26 ON e12.symbol = e26.symbol AND e12.i = e26.i), "
    + _ema_cte("sg", "m", "v", 9, 180)
    + """ SELECT n.symbol, n.ts, round(e3.v, 6) AS ema_3, round(e5.v, 6) AS ema_5, round(e10.v, 6) AS ema_10,
      round(m.v, 6) AS macd, round(sg.v, 6) AS macd_signal FROM n
      JOIN e3 ON n.symbol = e3.symbol AND n.i = e3.i JOIN e5 ON n.symbol = e5.symbol AND n.i = e5.i
      JOIN e10 ON n.symbol = e10.symbol AND n.i = e10.i JOIN m ON n.symbol = m.symbol AND n.i = m.i
      JOIN sg ON n.symbol = sg.symbol AND n.i = sg.i""",
)
def exponential_averages(spark, folder):
    return rounded(ops.exponential_averages(views.bars(spark, folder)).drop("close"))


@query(
    "W14",
    sql="""
WITH d AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS day, count(*) AS volume, max(value) AS high FROM events GROUP BY 1, 2)
SELECT symbol, day, volume, high FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM d) WHERE n >= 26
""",
)
def symbols_with_history(spark, folder):
    days = (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("symbol"), F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("volume"), F.max("value").alias("high"))
    )
    return ops.enough_history(days, 26)


@query(
    "W17",
    views="bars",
    sql="""
WITH x AS (SELECT symbol, ts AS last_ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS previous_close,
  row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars)
SELECT symbol, last_ts, close, previous_close, round(close - previous_close, 6) AS change,
       round((close - previous_close) / nullif(previous_close, 0) * 100, 6) AS change_pct FROM x WHERE r = 1
""",
)
def market_overview(spark, folder):
    return rounded(ops.latest_change(views.bars(spark, folder)), "close", "previous_close")
