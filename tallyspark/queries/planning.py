"""Queries over savings and allocation scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import planning
from tallyspark.queries.bars import rounded
from tallyspark.queries.registry import query
from tallyspark.sources.tables import table

_SCENARIOS_SQL = """
s AS (SELECT c_custkey AS id, greatest(c_acctbal, 0) AS initial, (c_custkey % 20) * 50.0::DOUBLE AS monthly, CAST(c_custkey % 13 AS DOUBLE) AS rate, 1 + c_custkey % 30 AS years FROM customer)
"""


def _scenarios(spark, folder):
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("id"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("initial"),
        ((key % 20) * 50.0).alias("monthly"),
        (key % 13).cast("double").alias("rate"),
        (1 + key % 30).alias("years"),
    )


def _value(years):
    return (
        f"initial * power(1 + rate / 100, {years}) + CASE WHEN rate > 0 THEN monthly * "
        f"(power(1 + rate / 1200, {years} * 12) - 1) / nullif(rate / 1200, 0) ELSE monthly * {years} * 12 END"
    )


@query(
    "F12",
    sql=f"""
WITH {_SCENARIOS_SQL}, v AS (SELECT *, initial + monthly * years * 12 AS invested, {_value("years")} AS fv FROM s)
SELECT id, round(invested, 2) AS invested, round(fv, 2) AS future_value, round(fv - invested, 2) AS earnings, round(fv / nullif(invested, 0), 6) AS multiple FROM v
""",
)
def compound_interest(spark, folder):
    out = planning.compound_interest(_scenarios(spark, folder))
    return out.select(
        "id",
        *[F.round(c, 2).alias(c) for c in ("invested", "future_value", "earnings")],
        F.round("multiple", 6).alias("multiple"),
    )


@query(
    "F13",
    sql=f"""
WITH {_SCENARIOS_SQL}, y AS (SELECT id, initial, monthly, rate, unnest(generate_series(0, CAST(years AS BIGINT))) AS year FROM s)
SELECT id, CAST(year AS INTEGER) AS year, round({_value("year")}, 2) AS balance FROM y
""",
)
def yearly_balances(spark, folder):
    out = planning.yearly_path(_scenarios(spark, folder))
    return out.select("id", "year", F.round("balance", 2).alias("balance"))


@query(
    "F14",
    sql="""
WITH a AS (SELECT c_custkey AS id, c_custkey % 61 AS stocks, c_custkey % 17 AS intl, c_custkey % 23 AS bonds FROM customer),
r AS (SELECT *, 100 - stocks - intl - bonds AS reits FROM a),
k AS (SELECT *, (stocks * 1.0::DOUBLE + intl * 0.9::DOUBLE + reits * 0.8::DOUBLE + bonds * 0.3::DOUBLE) / 100 AS risk FROM r)
SELECT id, stocks, intl, bonds, reits, round(risk, 6) AS risk_score, CASE WHEN risk < 0.4 THEN 'Conservative' WHEN risk < 0.7 THEN 'Moderate' ELSE 'Aggressive' END AS risk_level,
  round(5 + risk * 5, 6) AS expected_return, round(8 + risk * 12, 6) AS volatility FROM k
""",
)
def allocation_risk(spark, folder):
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        key.alias("id"), (key % 61).alias("stocks"), (key % 17).alias("intl"), (key % 23).alias("bonds")
    )
    return rounded(planning.allocation_risk(rows))
