"""Queries over the synthetic data job, grown from the customer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.queries.registry import query
from tallyspark.sources import synth
from tallyspark.sources.tables import spread, table

AS_OF, DAYS = "2024-01-31", 5


def _u(name, *keys):
    text = " || ':' || ".join([f"'42{name}'", *keys])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _whole(u, low, high):
    return f"({low} + CAST(floor({u} * {high - low + 1}) AS BIGINT))"


def _banded(value, bands, made):
    return "CASE " + " ".join(
        f"WHEN {value} < {limit} THEN {made(low, high)}" if limit else f"ELSE {made(low, high)}"
        for limit, low, high in bands
    ) + " END"


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(u, values):
    return f"({_list(values)})[CAST(floor({u} * {len(values)}) AS BIGINT) + 1]"


def _weighted(u, weights):
    out, acc, names = [], 0.0, list(weights)
    for name in names[:-1]:
        acc = round(acc + weights[name], 10)
        out.append(f"WHEN {u} < {acc!r}::DOUBLE THEN '{name}'")
    return "CASE " + " ".join(out) + f" ELSE '{names[-1]}' END"


_ID = "user_id"
_USERS_SQL = f"""
a AS (SELECT c_custkey AS user_id, CAST({_whole(_u("age", "c_custkey"), 22, 65)} AS INTEGER) AS age FROM customer),
people AS (SELECT user_id, age, CAST({_banded("age", synth.INCOME_BY_AGE, lambda lo, hi: _whole(_u("income", _ID), lo, hi))} AS DOUBLE) AS annual_income,
  'User ' || user_id AS name, CAST({_whole(_u("credit", _ID), 580, 850)} AS INTEGER) AS credit_score, CAST({_whole(_u("goal", _ID), 5000, 50000)} AS DOUBLE) AS savings_goal,
  {_pick(_u("risk", _ID), synth.RISKS)} AS risk_tolerance, DATE '{AS_OF}' - CAST({_whole(_u("created", _ID), 0, 730)} AS INTEGER) AS created_date FROM a)
"""


def _users(spark, folder):
    ids = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    return synth.users(ids, F.lit(AS_OF).cast("date"))


@query(
    "S20",
    sql=f"WITH {_USERS_SQL} SELECT *, round(annual_income / 12, 6) AS monthly_income FROM people",
)
def synthetic_users(spark, folder):
    return _users(spark, folder).withColumn("monthly_income", F.round("monthly_income", 6))


_RANGES = ", ".join(f"('{c}', {lo}, {hi})" for c, (_, lo, hi) in synth.EXPENSES.items())
_NAMES = ", ".join(f"('{c}', {_list(m)})" for c, m in synth.MERCHANTS.items())
_UN = (_ID, "n")
_TX_SQL = f"""
{_USERS_SQL},
k AS (SELECT user_id, annual_income / 12 AS income, unnest(range(1, CAST(floor((2 + {_u("perday", _ID)} * 6) * {DAYS}) AS BIGINT) + 1)) AS n FROM people),
t AS (SELECT *, CASE WHEN {_u("kind", *_UN)} < 0.1 THEN 'Income' ELSE 'Expense' END AS type, {_u("amount", *_UN)} AS d, {_u("category", *_UN)} AS c FROM k),
g AS (SELECT *, CASE WHEN type = 'Income' THEN {_weighted("c", synth.INCOMES)} ELSE {_weighted("c", {c: w for c, (w, _, _) in synth.EXPENSES.items()})} END AS category FROM t),
r AS (SELECT * FROM (VALUES {_RANGES}) x(category, lo, hi)), nm AS (SELECT * FROM (VALUES {_NAMES}) x(category, names)),
s AS (SELECT g.*, names, CASE category WHEN 'Salary' THEN income + (-0.1::DOUBLE + d * 0.2::DOUBLE) * income WHEN 'Freelance' THEN 500 + d * (income * 0.5 - 500)
  WHEN 'Investment' THEN 100 + d * (income * 0.3 - 100) ELSE 200 + d * (income * 0.2 - 200) END AS gain, (lo + d * (hi - lo)) * (income / 5000) AS spent
  FROM g LEFT JOIN r USING (category) LEFT JOIN nm USING (category)),
moves AS (SELECT user_id, n AS id, DATE '{AS_OF}' - CAST({_whole(_u("date", *_UN), 0, DAYS)} AS INTEGER) AS date, type, category,
  CASE WHEN type = 'Income' THEN round(gain, 2) WHEN category IN ('Housing', 'Insurance') THEN -round(spent / 10) * 10
       WHEN {_u("whole", *_UN)} < 0.3 THEN -round(spent) ELSE -round(spent, 2) END AS amount,
  CASE WHEN type = 'Income' THEN 'Company ' || {_whole(_u("merchant", *_UN), 1, 500)} ELSE names[CAST(floor({_u("merchant", *_UN)} * len(names)) AS BIGINT) + 1] END AS merchant FROM s)
"""


def _set(spark, folder):
    ids = spread(table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")))
    return synth.sample_set(ids, F.lit(AS_OF).cast("date"), DAYS)


@query(
    "S21 W1",
    sql=f"""
WITH {_TX_SQL} SELECT id, user_id, date, type, category, amount, merchant, category || ' - ' || merchant AS description,
  round(round(1000 + {_u("opening", _ID)} * 9000, 2) + sum(amount) OVER (PARTITION BY user_id ORDER BY date, id ROWS UNBOUNDED PRECEDING), 2) AS balance_after FROM moves
""",
)
def synthetic_transactions(spark, folder):
    return _set(spark, folder)["transactions"].withColumn("balance_after", F.round("balance_after", 2))


@query(
    "S23 A1",
    sql=f"""
WITH {_TX_SQL} SELECT user_id, strftime(date, '%Y-%m') AS year_month, round(sum(amount), 2) AS total_amount, count(*) AS transaction_count, min(date) AS first_date, max(date) AS last_date,
  round(sum(CASE WHEN type = 'Income' THEN amount ELSE 0 END), 2) AS total_income, round(sum(CASE WHEN type = 'Expense' THEN amount ELSE 0 END), 2) AS total_expenses,
  round(sum(amount), 2) AS net_savings FROM moves GROUP BY 1, 2
""",
)
def synthetic_summaries(spark, folder):
    out = _set(spark, folder)["monthly_summaries"]
    return out.withColumns(
        {c: F.round(c, 2) for c in ("total_amount", "total_income", "total_expenses", "net_savings")}
    )


_UI = (_ID, "id")
_COIN = f"symbol IN ({', '.join(repr(s) for s in synth.CRYPTO)})"
_FUND = f"symbol IN ({', '.join(repr(s) for s in synth.FUNDS)})"


@query(
    "S22 P20",
    sql=f"""
WITH {_USERS_SQL},
k AS (SELECT user_id, unnest(range(1, {_banded("annual_income", synth.POSITIONS_BY_INCOME, lambda lo, hi: _whole(_u("positions", _ID), lo, hi))} + 1)) AS id FROM people),
s AS (SELECT *, {_pick(_u("symbol", *_UI), synth.SECURITIES)} AS symbol FROM k),
p AS (SELECT *, CASE WHEN {_COIN} THEN 'Cryptocurrency' WHEN {_FUND} THEN 'ETF' ELSE 'Stock' END AS asset_type,
  CASE WHEN {_COIN} THEN round(0.1::DOUBLE + {_u("shares", *_UI)} * (10.0::DOUBLE - 0.1::DOUBLE), 4) WHEN {_FUND} THEN {_whole(_u("shares", *_UI), 1, 100)} ELSE {_whole(_u("shares", *_UI), 1, 200)} END AS shares,
  round(CASE WHEN {_COIN} THEN 100 + {_u("price", *_UI)} * 49900 WHEN {_FUND} THEN 50 + {_u("price", *_UI)} * 450 ELSE 20 + {_u("price", *_UI)} * 2980 END, 2) AS current_price FROM s)
SELECT user_id, id, symbol, asset_type, shares, current_price, round(current_price * (0.7::DOUBLE + {_u("cost", *_UI)} * (1.3::DOUBLE - 0.7::DOUBLE)), 2) AS purchase_price,
  DATE '{AS_OF}' - CAST({_whole(_u("bought", *_UI), 0, 730)} AS INTEGER) AS purchase_date FROM p
""",
)
def synthetic_portfolios(spark, folder):
    out = _set(spark, folder)["portfolios"]
    return out.drop("current_value", "total_return", "return_percentage")
