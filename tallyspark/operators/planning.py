"""Savings and allocation formulas over scenario tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import safe_div

# Risk share of each asset class and the label limits.
RISK_SHARES = {"stocks": 1.0, "intl": 0.9, "reits": 0.8, "bonds": 0.3}
RISK_LABELS = [(0.4, "Conservative"), (0.7, "Moderate")]
TOP_RISK_LABEL = "Aggressive"


def balance_after(initial: Column, monthly: Column, rate_percent: Column, years: Column) -> Column:
    """Yearly compounding of the initial amount, monthly compounding of contributions."""
    r = rate_percent / 100
    m = r / 12
    grown = initial * F.pow(1 + r, years)
    saved = F.when(m > 0, monthly * F.try_divide(F.pow(1 + m, years * 12) - 1, m)).otherwise(monthly * years * 12)
    return grown + saved


def compound_interest(scenarios: DataFrame) -> DataFrame:
    years = F.col("years")
    invested = F.col("initial") + F.col("monthly") * years * 12
    value = balance_after(F.col("initial"), F.col("monthly"), F.col("rate"), years)
    out = scenarios.withColumns({"invested": invested, "future_value": value})
    return out.withColumns(
        {
            "earnings": F.col("future_value") - F.col("invested"),
            "multiple": safe_div(F.col("future_value"), F.col("invested")),
        }
    )


def yearly_path(scenarios: DataFrame) -> DataFrame:
    """One row per scenario and year, from year 0."""
    spread = scenarios.withColumn("year", F.explode(F.sequence(F.lit(0), F.col("years").cast("int"))))
    return spread.withColumn(
        "balance", balance_after(F.col("initial"), F.col("monthly"), F.col("rate"), F.col("year"))
    )


def allocation_risk(allocations: DataFrame) -> DataFrame:
    """Risk, label, expected return and volatility; REITs take the remainder."""
    full = allocations.withColumn("reits", 100 - F.col("stocks") - F.col("intl") - F.col("bonds"))
    risk = sum((F.col(c) * w for c, w in RISK_SHARES.items()), F.lit(0.0)) / 100
    label = None
    for limit, name in RISK_LABELS:
        under = F.col("risk_score") < limit
        label = F.when(under, name) if label is None else label.when(under, name)
    return full.withColumn("risk_score", risk).withColumns(
        {
            "risk_level": label.otherwise(TOP_RISK_LABEL),
            "expected_return": 5 + F.col("risk_score") * 5,
            "volatility": 8 + F.col("risk_score") * 12,
        }
    )
