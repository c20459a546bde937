"""Queries over cleaning steps and quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import anomaly, cleaner, cleaning, quality
from tallyspark.plans.keyed import table_quantiles, with_scalars
from tallyspark.queries.bars import rounded
from tallyspark.plans.lineage import fresh_dir
from tallyspark.queries.registry import query
from tallyspark.sources import views
from tallyspark.sources.tables import table
from tallyspark.sources.views import EVENTS_AS_OF

KEY, ORDER = ["key"], ["ts", "id"]

_SPARSE_SQL = """
sparse AS (SELECT CASE WHEN k % 10 = 0 THEN NULL ELSE kind END AS kind,
  CASE WHEN k % 10 = 0 OR k % 4 = 0 THEN NULL ELSE k % 6 END AS bucket,
  CASE WHEN k % 10 = 0 THEN NULL ELSE floor(full_value / 50) END AS level FROM readings)
"""


def _sparse(spark, folder):
    k = F.col("k")
    return views.readings(spark, folder).select(
        F.when(k % 10 != 0, F.col("kind")).alias("kind"),
        F.when((k % 10 != 0) & (k % 4 != 0), k % 6).alias("bucket"),
        F.when(k % 10 != 0, F.floor(F.col("full_value") / 50).cast("double")).alias("level"),
    )


@query(
    "P1 P2 P3 P4 P5 U2",
    views="readings",
    sql=f"""WITH {_SPARSE_SQL}
SELECT DISTINCT kind, bucket, level FROM sparse
WHERE NOT (kind IS NULL AND bucket IS NULL AND level IS NULL)
  AND NOT (coalesce(bucket = 0, FALSE) AND coalesce(level = 0, FALSE))
""",
)
def basic_cleaning(spark, folder):
    """An empty column and untidy names are added first, so every step has work."""
    raw = _sparse(spark, folder).withColumn("empty", F.lit(None).cast("double"))
    return cleaning.basic_cleaning(raw.toDF(" Kind ", "Bucket", "LEVEL ", "Empty Column"))


@query(
    "P1",
    views="readings",
    sql=f"WITH {_SPARSE_SQL} SELECT * FROM sparse WHERE NOT (kind IS NULL AND bucket IS NULL AND level IS NULL)",
)
def drop_empty_rows(spark, folder):
    return cleaning.drop_empty_rows(_sparse(spark, folder))


@query("P3 U2", views="readings", sql="SELECT DISTINCT kind, k, category FROM readings")
def distinct_rows(spark, folder):
    return views.readings(spark, folder).select("kind", "k", "category").dropDuplicates()


@query(
    "P5",
    views="readings",
    sql=f"""WITH {_SPARSE_SQL} SELECT kind, bucket, level FROM sparse
WHERE NOT (coalesce(bucket = 0, FALSE) AND coalesce(level = 0, FALSE))""",
)
def drop_zero_rows(spark, folder):
    return cleaning.drop_zero_rows(_sparse(spark, folder))


@query(
    "W11",
    views="readings",
    sql="""
SELECT id, key, ts, coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM readings
""",
)
def forward_back_fill(spark, folder):
    rows = views.readings(spark, folder).select("id", "key", "ts", "value")
    return cleaning.forward_back_fill(rows, ["value"], KEY, ORDER)


@query(
    "W12",
    views="readings",
    sql="""
WITH r AS (SELECT id, key, ts, CASE WHEN k % 3 = 0 THEN NULL ELSE value END AS value,
  row_number() OVER (PARTITION BY key ORDER BY ts, id) AS i FROM readings),
w AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS p, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi,
  first_value(value IGNORE NULLS) OVER b AS n, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni FROM r
  WINDOW a AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT id, key, ts, round(CASE WHEN value IS NOT NULL THEN value WHEN ni IS NULL THEN p
  ELSE p + (n - p) * (i - pi) / nullif(ni - pi, 0) END, 6) AS value FROM w
""",
)
def interpolated_readings(spark, folder):
    rows = views.readings(spark, folder).select(
        "id", "key", "ts", F.when(F.col("k") % 3 != 0, F.col("value")).alias("value")
    )
    return rounded(cleaning.interpolate(rows, ["value"], KEY, ORDER))


@query(
    "P6 A12",
    views="readings",
    sql="""
WITH r AS (SELECT id, key, ts, value, category, CASE WHEN k % 5 = 0 THEN NULL ELSE k END AS k,
  CASE WHEN k % 3 = 0 THEN NULL ELSE full_value END AS full_value FROM readings),
m AS (SELECT quantile_cont(k, 0.5) AS k FROM r),
c AS (SELECT category FROM r WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 1),
w AS (SELECT r.*, row_number() OVER a AS i,
  last_value(value IGNORE NULLS) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f,
  first_value(value IGNORE NULLS) OVER (a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM r WINDOW a AS (PARTITION BY key ORDER BY ts, id)),
x AS (SELECT *, CASE WHEN full_value IS NOT NULL THEN i END AS pos FROM w),
y AS (SELECT *, last_value(full_value IGNORE NULLS) OVER p AS pv, last_value(pos IGNORE NULLS) OVER p AS pi,
  first_value(full_value IGNORE NULLS) OVER n AS nv, first_value(pos IGNORE NULLS) OVER n AS ni FROM x
  WINDOW p AS (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT id, key, ts, coalesce(f, b) AS value, coalesce(y.category, c.category) AS category,
  coalesce(CAST(y.k AS DOUBLE), m.k) AS k,
  round(CASE WHEN full_value IS NOT NULL THEN full_value WHEN ni IS NULL THEN pv
       ELSE pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0) END, 6) AS full_value
FROM y, m, c
""",
)
def missing_value_policy(spark, folder):
    """One column per branch: carried value, median k, interpolated full_value, mode category."""
    k = F.col("k")
    rows = views.readings(spark, folder).select(
        "id",
        "key",
        "ts",
        "value",
        "category",
        F.when(k % 5 != 0, k).alias("k"),
        F.when(k % 3 != 0, F.col("full_value")).alias("full_value"),
        F.when(k == 0, F.lit("x")).alias("mostly_missing"),
    )
    return cleaning.fill_missing(rows, KEY, ORDER).withColumn("full_value", F.round("full_value", 6))


@query(
    "P7 P8 P9",
    views="readings",
    sql="""
SELECT id, kind AS label, CAST(ts AS TIMESTAMP) AS created, CASE WHEN k % 9 = 0 THEN NULL ELSE round(full_value * 1000, 2) END AS price FROM readings
""",
)
def standardised_formats(spark, folder):
    """Padded upper-case labels, times as text and prices such as ``$1,234.50``."""
    rows = views.readings(spark, folder).select(
        "id",
        F.concat(F.lit("  "), F.upper("kind"), F.lit(" ")).alias("label"),
        F.col("ts").cast("string").alias("created"),
        F.when(F.col("k") % 9 == 0, "n/a")
        .otherwise(F.concat(F.lit("$"), F.format_number(F.col("full_value") * 1000, 2)))
        .alias("price"),
    )
    return cleaning.standardise_formats(rows)


@query(
    "P10 P11 W13",
    views="readings",
    sql="""
WITH r AS (SELECT id, key, ts, category, value AS amount FROM readings),
p AS (SELECT quantile_cont(abs(amount), 0.95) AS p95 FROM r)
SELECT id, key, ts, category, amount,
  (3 + CAST(category IS NOT NULL AS INTEGER) + CAST(amount IS NOT NULL AS INTEGER)) / 5.0::DOUBLE AS _record_completeness,
  CAST(hour(ts) AS INTEGER) AS _hour, CAST(isodow(ts) - 1 AS INTEGER) AS _day_of_week, isodow(ts) >= 6 AS _is_weekend,
  abs(amount) AS _amount_abs, coalesce(abs(amount) > p95, FALSE) AS _is_large_transaction,
  round(avg(amount) OVER w, 6) AS _amount_rolling_mean, round(stddev_samp(amount) OVER w, 6) AS _amount_rolling_std
FROM r, p WINDOW w AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
""",
)
def quality_columns(spark, folder):
    rows = views.readings(spark, folder).select("id", "key", "ts", "category", F.col("value").alias("amount"))
    out = cleaning.quality_columns(rows, KEY, ORDER)
    return rounded(out, "amount", "_amount_abs", "_record_completeness")


@query(
    "P12",
    views="transactions",
    sql="""
WITH t AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'credit card' WHEN id % 3 = 1 THEN 'debit' ELSE 'transfer' END AS transaction_type, amount FROM transactions)
SELECT id, transaction_type, CASE WHEN transaction_type LIKE '%credit%' AND amount < 0 THEN -amount
  WHEN transaction_type LIKE '%debit%' AND amount > 0 THEN -amount ELSE amount END AS amount FROM t
""",
)
def repaired_signs(spark, folder):
    tx = views.transactions(spark, folder).select(
        "id",
        F.when(F.col("id") % 3 == 0, "credit card")
        .when(F.col("id") % 3 == 1, "debit")
        .otherwise("transfer")
        .alias("transaction_type"),
        "amount",
    )
    return cleaning.repair_signs(tx)


@query(
    "P13",
    sql="""
WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN ts - INTERVAL 150 YEAR ELSE ts END AS ts FROM events)
SELECT * FROM t WHERE ts IS NULL OR (ts <= TIMESTAMP '2024-01-20 00:00:00' AND ts >= TIMESTAMP '1900-01-01 00:00:00')
""",
)
def possible_times(spark, folder):
    key = F.col("event_id") % 10
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(key == 1, F.col("ts") - F.expr("INTERVAL 150 YEARS")).when(key != 0, F.col("ts")).alias("ts"),
    )
    return cleaning.drop_impossible_times(rows, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


_RECORDS_SQL = """
records AS (SELECT id, CASE WHEN id % 31 = 0 THEN NULL ELSE date END AS "timestamp",
  CASE WHEN id % 37 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id, amount * 2500 AS amount,
  CASE id % 7 WHEN 0 THEN 'Debit' WHEN 1 THEN 'CREDIT' WHEN 2 THEN 'transfer' WHEN 3 THEN 'Payment' WHEN 4 THEN 'refund' WHEN 5 THEN 'gift' ELSE NULL END AS transaction_type
  FROM transactions)
"""


def _records(spark, folder):
    k = F.col("id")
    kinds = F.array(*[F.lit(x) for x in ["Debit", "CREDIT", "transfer", "Payment", "refund", "gift"]])
    return views.transactions(spark, folder).select(
        "id",
        F.when(k % 31 != 0, F.col("date")).alias("timestamp"),
        F.when(k % 37 != 0, F.col("user_id").cast("string")).alias("user_id"),
        (F.col("amount") * 2500).alias("amount"),
        F.get(kinds, (k % 7).cast("int")).alias("transaction_type"),
    )


@query(
    "P14 X1",
    views="transactions",
    sql=f"""WITH {_RECORDS_SQL}
SELECT id, lower(transaction_type) AS transaction_type, array_to_string(list_filter([
  CASE WHEN "timestamp" IS NULL THEN 'timestamp is required' END,
  CASE WHEN user_id IS NULL THEN 'user_id is required' END,
  CASE WHEN amount IS NULL THEN 'amount is required' END,
  CASE WHEN amount < -1000000 THEN 'amount too negative' END,
  CASE WHEN amount > 1000000000 THEN 'amount too large' END,
  CASE WHEN transaction_type IS NULL OR lower(transaction_type) NOT IN ('debit','credit','transfer','payment','refund') THEN 'invalid transaction type' END
  ], lambda x: x IS NOT NULL), '; ') AS errors FROM records
""",
)
def validated_records(spark, folder):
    checked = cleaning.validate_records(_records(spark, folder))
    return checked.select("id", "transaction_type", F.array_join("errors", "; ").alias("errors"))


_Q = "readings"


@query(
    "A5",
    views=_Q,
    sql="SELECT (count(value) + count(category) + count(k)) / (3.0::DOUBLE * count(*)) AS completeness FROM readings",
)
def completeness(spark, folder):
    rows = views.readings(spark, folder).select("value", "category", "k")
    return rows.agg(quality.completeness(rows))


@query(
    "A6",
    views=_Q,
    sql="""
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(k, 0.25) AS c, quantile_cont(k, 0.75) AS d FROM readings)
SELECT (count(*) FILTER (value >= a - 3 * (b - a) AND value <= b + 3 * (b - a))
      + count(*) FILTER (k >= c - 3 * (d - c) AND k <= d + 3 * (d - c))) / (3.0::DOUBLE * count(*)) AS accuracy FROM readings, q
""",
)
def accuracy(spark, folder):
    return quality.accuracy(views.readings(spark, folder).select("value", "category", "k"))


@query(
    "A6 X1",
    views=_Q,
    sql="""
SELECT (count(*) FILTER (value > 20) + count(*) FILTER (category <> 'view')) / (3.0::DOUBLE * count(*)) AS accuracy FROM readings
""",
)
def accuracy_by_rules(spark, folder):
    rows = views.readings(spark, folder).select("value", "category", "k")
    return quality.accuracy(rows, {"value": F.col("value") > 20, "category": F.col("category") != "view"})


_QUALITY_SQL = """
WITH q AS (SELECT quantile_cont(k, 0.25) AS c, quantile_cont(k, 0.75) AS d FROM readings),
g AS (SELECT count(*) AS n FROM readings GROUP BY kind, category, k, date_trunc('hour', ts)),
u AS (SELECT sum(n - 1)::DOUBLE / sum(n) AS dup FROM g),
s AS (SELECT count(*) AS rows,
  (count(kind) + count(category) + count(k) + count(ts)) / (4.0::DOUBLE * count(*)) AS completeness,
  count(*) FILTER (k >= c - 3 * (d - c) AND k <= d + 3 * (d - c)) / (4.0::DOUBLE * count(*)) AS accuracy,
  count(DISTINCT length(kind)) > 0.5 * count(kind) AS r1, count(DISTINCT length(category)) > 0.5 * count(category) AS r2,
  greatest(0, 1 - floor((epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('hour', max(ts)))) / 86400) / 30.0::DOUBLE) AS timeliness
  FROM readings, q),
t AS (SELECT completeness, accuracy, greatest(0, 1 - 0.3::DOUBLE * dup - CASE WHEN r1 THEN 0.1 ELSE 0 END - CASE WHEN r2 THEN 0.1 ELSE 0 END) AS consistency,
  rows / 12000.0::DOUBLE AS validity, 1 - dup AS uniqueness, timeliness FROM s, u),
o AS (SELECT *, list_avg(list_filter([completeness, accuracy, consistency, validity, uniqueness, timeliness], lambda x: x > 0)) AS overall FROM t)
SELECT round(completeness, 6) AS completeness, round(accuracy, 6) AS accuracy, round(consistency, 6) AS consistency,
  round(validity, 6) AS validity, round(uniqueness, 6) AS uniqueness, round(timeliness, 6) AS timeliness, round(overall, 6) AS overall,
  CASE WHEN overall >= 0.9 THEN 'excellent' WHEN overall >= 0.8 THEN 'good' WHEN overall >= 0.7 THEN 'fair' WHEN overall >= 0.6 THEN 'poor' ELSE 'critical' END AS level FROM o
"""


@query("A5 A6 A7 A8 A9", views=_Q, sql=_QUALITY_SQL)
def quality_scores(spark, folder):
    """12,000 stands for the row count before cleaning."""
    rows = views.readings(spark, folder).select(
        "kind", "category", "k", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    )
    return rounded(quality.scores(rows, 12_000, F.lit(EVENTS_AS_OF).cast("timestamp_ntz")))


@query(
    "A7",
    sql="""
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT sum(n - 1)::DOUBLE / sum(n) AS duplicates FROM g
""",
)
def duplicate_share(spark, folder):
    return quality.duplicate_share(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "A20",
    sql="""
SELECT quantile_cont(l_extendedprice, 0.01) AS p1, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.75) AS p75,
  quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem
""",
)
def price_percentiles(spark, folder):
    probabilities = {"p1": 0.01, "p25": 0.25, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return table_quantiles(
        table(spark, folder, "lineitem"), {n: ("l_extendedprice", p) for n, p in probabilities.items()}
    )


@query(
    "J8",
    sql="""
WITH s AS (SELECT max(o_totalprice) AS m, avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS d FROM orders)
SELECT o_orderkey, round(o_totalprice / m, 8) AS of_max, round((o_totalprice - a) / d, 6) AS z FROM orders, s
""",
)
def scaled_by_table_statistics(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    stats = orders.agg(
        F.max("o_totalprice").alias("m"), F.avg("o_totalprice").alias("a"), F.stddev_pop("o_totalprice").alias("d")
    )
    price = F.col("o_totalprice")
    return with_scalars(orders, stats).select(
        "o_orderkey",
        F.round(price / F.col("m"), 8).alias("of_max"),
        F.round((price - F.col("a")) / F.col("d"), 6).alias("z"),
    )


def votes_sql(src: str, col: str, out: str, keep: str) -> str:
    """CTEs that add the three outlier votes of one whole-table column."""
    return f"""
{out}_s AS (SELECT count({col}) AS n, avg({col}) AS mu, stddev_pop({col}) AS sd, kurtosis_pop({col}) AS ku,
  quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3, quantile_cont({col}, 0.5) AS med FROM {src}),
{out}_k AS (SELECT avg(power({col} - mu, 3)) / power(avg(power({col} - mu, 2)), 1.5) AS sk, quantile_cont(abs({col} - med), 0.5) AS mad FROM {src}, {out}_s),
{out} AS (SELECT {keep},
  CASE WHEN n >= 10 AND abs(({col} - mu) / nullif(sd, 0)) > CASE WHEN n > 100 THEN 3 * CASE WHEN abs(sk) > 1 THEN 1.2 ELSE 1 END * CASE WHEN ku > 3 THEN 1.1 ELSE 1 END ELSE 3 END THEN 1 ELSE 0 END
  + CASE WHEN n >= 4 AND ({col} < q1 - 1.5 * (q3 - q1) OR {col} > q3 + 1.5 * (q3 - q1)) THEN 1 ELSE 0 END
  + CASE WHEN n >= 10 AND mad > 0 AND 0.6745 * abs({col} - med) / nullif(mad, 0) > 3.5 THEN 1 ELSE 0 END AS votes
  FROM {src}, {out}_s, {out}_k)"""


@query(
    "D6",
    views="readings",
    sql=f"""
WITH r AS (SELECT id, value, full_value * k AS energy FROM readings), {votes_sql("r", "energy", "e", "id, value, energy")},
f AS (SELECT id, value, energy FROM e WHERE votes < 3), {votes_sql("f", "value", "v", "id, value, energy")},
lim AS (SELECT quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99 FROM f), found AS (SELECT max(votes) >= 2 AS hit FROM v)
SELECT id, round(energy, 6) AS energy, round(CASE WHEN hit AND value IS NOT NULL THEN greatest(least(value, p99), p1) ELSE value END, 6) AS value FROM v, lim, found
""",
)
def outliers_handled(spark, folder):
    rows = views.readings(spark, folder).select("id", "value", (F.col("full_value") * F.col("k")).alias("energy"))
    return rounded(anomaly.handle_outliers(rows, ["energy", "value"], target="value"))


def _dirty(spark, folder):
    """Transactions with text amounts, padded labels, gaps, zero rows, repeats and odd times."""
    k = F.col("id")
    rows = views.readings(spark, folder).select(
        "id",
        "key",
        F.when(k % 97 == 0, F.col("ts") + F.expr("INTERVAL 10 YEARS")).otherwise(F.col("ts")).alias("ts"),
        F.col("value").alias("amount"),
        F.when(k % 2 == 0, " CREDIT ").otherwise("Debit").alias("Transaction Type"),
        F.when(k % 7 != 0, F.upper("kind")).alias("Category"),
        F.lit(None).cast("double").alias("Empty"),
    )
    return rows.unionByName(rows.filter(k % 10 == 3))


_DIRTY_SQL = f"""
d AS (SELECT id, key, CASE WHEN id % 97 = 0 THEN ts + INTERVAL 10 YEAR ELSE ts END AS ts, value AS amount,
  CASE WHEN id % 2 = 0 THEN ' CREDIT ' ELSE 'Debit' END AS transaction_type, CASE WHEN id % 7 = 0 THEN NULL ELSE upper(kind) END AS category FROM readings),
c AS (SELECT category FROM d WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 1),
f AS (SELECT d.id, d.key, d.ts, d.transaction_type, coalesce(d.category, c.category) AS category, coalesce(
  last_value(amount IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(amount IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS amount FROM d, c),
{votes_sql("f", "amount", "v", "id, key, ts, transaction_type, category, amount")},
lim AS (SELECT quantile_cont(amount, 0.01) AS p1, quantile_cont(amount, 0.99) AS p99 FROM f), hit AS (SELECT max(votes) >= 2 AS hit FROM v),
o AS (SELECT id, key, ts, lower(trim(transaction_type)) AS transaction_type, lower(trim(category)) AS category,
  CASE WHEN hit THEN greatest(least(amount, p99), p1) ELSE amount END AS amount FROM v, lim, hit),
p AS (SELECT quantile_cont(abs(amount), 0.95) AS p95 FROM o),
q AS (SELECT id, key, ts, transaction_type, category, amount, abs(amount) > p95 AS large, avg(amount) OVER w AS m, stddev_samp(amount) OVER w AS s FROM o, p
  WINDOW w AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
cleaned AS (SELECT id, key, ts, transaction_type, category, CASE WHEN transaction_type = 'debit' AND amount > 0 THEN -amount ELSE amount END AS amount,
  large, m, s FROM q WHERE ts <= TIMESTAMP '{EVENTS_AS_OF}')
"""


@query(
    "A18 D15",
    views="readings",
    sql=f"""
WITH {_DIRTY_SQL}, counters AS (
  SELECT (SELECT count(*) + count(*) FILTER (id % 10 = 3) FROM readings) AS rows_in, (SELECT count(*) FROM f) AS basic, (SELECT count(*) FROM o) AS after, (SELECT count(*) FROM cleaned) AS rows_out,
    (SELECT count(*) FROM v WHERE votes >= 2) AS outliers, (SELECT count(*) FROM v, lim, hit WHERE hit AND greatest(least(amount, p99), p1) <> amount) AS changed)
SELECT 'first' AS run, unnest(['rows in', 'basic cleaning', 'outliers', 'possible times', 'outliers in amount', 'outliers in amount', 'outliers in amount']) AS step,
  unnest(['rows', 'rows', 'rows', 'rows', 'changed', 'outliers', 'rows']) AS counter, unnest([rows_in, basic, after, rows_out, changed, outliers, basic]) AS n FROM counters
""",
)
def observed_cleaning(spark, folder):
    """Counters of a whole cleaning run, gathered on its way and added to a table of runs."""
    dirty = _dirty(spark, folder)
    _, _, counts = cleaner.cleaned_with_counts(dirty, KEY, ORDER, F.lit(EVENTS_AS_OF).cast("timestamp_ntz"), target="amount")
    return cleaner.append_counts(counts, fresh_dir(spark, "counters"), "first").drop("place")


def _cleaned(spark, folder):
    return cleaner.clean_financial_data(
        _dirty(spark, folder),
        KEY,
        ORDER,
        F.lit(EVENTS_AS_OF).cast("timestamp_ntz"),
        target="amount",
    )


@query(
    "D15 P4 P6 P12 P13",
    views="readings",
    sql=f"""
WITH {_DIRTY_SQL} SELECT id, key, ts, transaction_type, category, round(amount, 6) AS amount, large AS _is_large_transaction,
  round(m, 9) AS _amount_rolling_mean, round(s, 6) AS _amount_rolling_std FROM cleaned
""",
)
def cleaned_records(spark, folder):
    rows, _ = _cleaned(spark, folder)
    shown = rows.select(
        "id", "key", "ts", "transaction_type", "category", "amount", "_is_large_transaction",
        F.round("_amount_rolling_mean", 9).alias("_amount_rolling_mean"), "_amount_rolling_std",
    )
    return rounded(shown, "_amount_rolling_mean")


@query(
    "D15 A8 A9",
    views="readings",
    sql=f"""
WITH {_DIRTY_SQL}, n AS (SELECT count(*) + count(*) FILTER (id % 10 = 3) AS before FROM readings)
SELECT round((count(*) * 14.0::DOUBLE - count(*) FILTER (s IS NULL)) / (14.0::DOUBLE * count(*)), 9) AS completeness,
  round(count(*) / any_value(before)::DOUBLE, 9) AS validity, 1.0::DOUBLE AS uniqueness,
  round(greatest(0, 1 - floor((epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(max(ts))) / 86400) / 30.0::DOUBLE), 9) AS timeliness FROM cleaned, n
""",
)
def cleaned_quality(spark, folder):
    _, scores = _cleaned(spark, folder)
    return rounded(scores.select("completeness", "validity", "uniqueness", "timeliness"), digits=9)


@query(
    "A18",
    views="readings",
    sql="""
WITH n AS (SELECT count(*) + count(*) FILTER (id % 10 = 3) AS rows_in, count(*) AS rows_out FROM readings)
SELECT rows_in, rows_out, rows_in - rows_out AS rows_removed FROM n
""",
)
def cleaning_counts(spark, folder):
    dirty = _dirty(spark, folder)
    return cleaner.cleaning_counts(dirty, cleaning.basic_cleaning(dirty))


@query(
    "A18 P1 P3 P5 P13",
    views="readings",
    sql=f"""
WITH n AS (SELECT count(*) AS a, count(*) FILTER (id % 10 = 3) AS twice, count(*) FILTER (key = 0 AND id = 0 AND value = 0) AS z,
  count(*) FILTER (NOT (key = 0 AND id = 0 AND coalesce(value, 1) = 0) AND CASE WHEN id % 97 = 0 THEN ts + INTERVAL 10 YEAR ELSE ts END > TIMESTAMP '{EVENTS_AS_OF}') AS odd FROM readings)
SELECT 'rows in' AS step, a + twice AS rows_left, 0::BIGINT AS rows_removed FROM n UNION ALL SELECT 'empty', a + twice, 0 FROM n
UNION ALL SELECT 'repeated', a, twice FROM n UNION ALL SELECT 'zero', a - z, z FROM n UNION ALL SELECT 'impossible time', a - z - odd, odd FROM n
""",
)
def removed_by_kind(spark, folder):
    return cleaner.removed_by_kind(_dirty(spark, folder).drop("Empty"), F.lit(EVENTS_AS_OF).cast("timestamp_ntz"))
