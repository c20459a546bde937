"""Repeatable synthetic users, transactions and portfolios.

Every value is a function of a seed and the row's key, so any partition can be made
anywhere and a lost one comes back the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import pick, uniform, weighted_pick
from tallyspark.operators.ledger import monthly_summary, position_values, running_balance

# Share and amount range of each expense category.
EXPENSES = {
    "Housing": (0.30, 800, 3000),
    "Food": (0.15, 200, 800),
    "Transportation": (0.12, 100, 600),
    "Utilities": (0.08, 80, 300),
    "Healthcare": (0.06, 50, 500),
    "Entertainment": (0.08, 50, 400),
    "Shopping": (0.10, 100, 600),
    "Insurance": (0.05, 100, 400),
    "Savings": (0.04, 100, 1000),
    "Miscellaneous": (0.02, 20, 200),
}

# Share of each income source.
INCOMES = {"Salary": 0.70, "Freelance": 0.15, "Investment": 0.08, "Side Business": 0.05, "Other": 0.02}

# Merchants of each category.
MERCHANTS = {
    "Housing": ["Property Management Co", "Landlord Services", "Mortgage Corp"],
    "Food": ["Walmart", "Target", "Kroger", "Whole Foods", "Local Restaurant", "Fast Food Chain"],
    "Transportation": ["Shell", "BP", "Exxon", "Uber", "Lyft", "Metro Transit"],
    "Utilities": ["Electric Company", "Gas Company", "Water Department", "Internet Provider"],
    "Healthcare": ["Medical Center", "Pharmacy", "Dental Office", "Eye Care"],
    "Entertainment": ["Netflix", "Spotify", "Movie Theater", "Concert Venue"],
    "Shopping": ["Amazon", "Best Buy", "Clothing Store", "Department Store"],
    "Insurance": ["Auto Insurance", "Health Insurance", "Life Insurance"],
    "Savings": ["Savings Account", "Investment Account", "Retirement Fund"],
    "Miscellaneous": ["ATM Withdrawal", "Bank Fee", "Various"],
}

# Securities by type, with share and price ranges.
CRYPTO = ["BTC", "ETH", "ADA", "DOT", "LINK", "UNI"]
FUNDS = ["SPY", "QQQ", "VTI", "VEA", "VWO", "BND", "VXUS", "VOO"]
STOCKS = ["AAPL", "GOOGL", "MSFT", "AMZN", "TSLA", "META", "NFLX", "NVDA"]
SECURITIES = STOCKS + FUNDS + CRYPTO

# Income range by age, positions by income, other ranges of a profile.
INCOME_BY_AGE = [(30, 35000, 65000), (45, 45000, 120000), (None, 55000, 150000)]
POSITIONS_BY_INCOME = [(50000, 3, 8), (100000, 5, 15), (None, 8, 25)]
RISKS = ["Conservative", "Moderate", "Aggressive"]
AGES, CREDIT, GOALS, HISTORY_DAYS = (22, 65), (580, 850), (5000, 50000), 730
INCOME_SHARE, WHOLE_SHARE, PER_DAY, OPENING = 0.1, 0.3, (2, 8), (1000, 10000)


def _whole(u: Column, low, high) -> Column:
    """Whole number in [low, high]."""
    return low + F.floor(u * (high - low + 1))


def _between(u: Column, low, high) -> Column:
    return low + u * (high - low)


def _banded(value: Column, bands, pick_range) -> Column:
    out = None
    for limit, low, high in bands:
        made = pick_range(low, high)
        if limit is None:
            return out.otherwise(made)
        out = F.when(value < limit, made) if out is None else out.when(value < limit, made)
    return out


def users(ids: DataFrame, as_of: Column, seed: str = "42") -> DataFrame:
    """One profile per ``user_id``."""
    key = F.col("user_id")

    def u(name: str) -> Column:
        return uniform(seed + name, key)

    out = ids.select("user_id").withColumn("age", _whole(u("age"), *AGES).cast("int"))
    income = _banded(F.col("age"), INCOME_BY_AGE, lambda low, high: _whole(u("income"), low, high))
    out = out.withColumn("annual_income", income.cast("double"))
    return out.withColumns(
        {
            "name": F.concat(F.lit("User "), key.cast("string")),
            "monthly_income": F.col("annual_income") / 12,
            "credit_score": _whole(u("credit"), *CREDIT).cast("int"),
            "savings_goal": _whole(u("goal"), *GOALS).cast("double"),
            "risk_tolerance": pick(u("risk"), RISKS),
            "created_date": F.date_sub(as_of, _whole(u("created"), 0, HISTORY_DAYS).cast("int")),
        }
    )


def transactions(profiles: DataFrame, end: Column, days: int = 365, seed: str = "42") -> DataFrame:
    """Two to eight transactions a day per user over ``days`` days, without the balance."""
    per_day = _between(uniform(seed + "perday", F.col("user_id")), *PER_DAY)
    count = F.floor(per_day * days)
    rows = profiles.select("user_id", "monthly_income", F.explode(F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).alias("n"))

    def u(name: str) -> Column:
        return uniform(seed + name, F.col("user_id"), F.col("n"))

    income = F.col("monthly_income")
    rows = rows.withColumns(
        {
            "date": F.date_sub(end, _whole(u("date"), 0, days).cast("int")),
            "type": F.when(u("kind") < INCOME_SHARE, "Income").otherwise("Expense"),
            "_u": u("amount"),
        }
    )
    earned = F.col("type") == "Income"
    rows = rows.withColumn(
        "category",
        F.when(earned, weighted_pick(u("category"), INCOMES)).otherwise(
            weighted_pick(u("category"), {c: w for c, (w, _, _) in EXPENSES.items()})
        ),
    )
    kind, draw = F.col("category"), F.col("_u")
    gain = (
        F.when(kind == "Salary", income + _between(draw, -0.1, 0.1) * income)
        .when(kind == "Freelance", 500 + draw * (income * 0.5 - 500))
        .when(kind == "Investment", 100 + draw * (income * 0.3 - 100))
        .otherwise(200 + draw * (income * 0.2 - 200))
    )
    spent = None
    for name, (_, low, high) in EXPENSES.items():
        made = (low + draw * (high - low)) * (income / 5000)
        spent = F.when(kind == name, made) if spent is None else spent.when(kind == name, made)
    spent = (
        F.when(kind.isin("Housing", "Insurance"), F.round(spent / 10) * 10)
        .when(u("whole") < WHOLE_SHARE, F.round(spent))
        .otherwise(spent)
    )
    merchant = None
    for name, names in MERCHANTS.items():
        chosen = pick(u("merchant"), names)
        merchant = F.when(kind == name, chosen) if merchant is None else merchant.when(kind == name, chosen)
    out = rows.withColumns(
        {
            "amount": F.when(earned, F.round(gain, 2)).otherwise(-F.round(spent, 2)),
            "merchant": F.when(earned, F.concat(F.lit("Company "), _whole(u("merchant"), 1, 500).cast("string"))).otherwise(
                merchant
            ),
        }
    )
    return out.withColumn("description", F.concat_ws(" - ", "category", "merchant")).select(
        "user_id", F.col("n").alias("id"), "date", "type", "category", "amount", "description", "merchant"
    )


def opening_balances(profiles: DataFrame, seed: str = "42") -> DataFrame:
    drawn = _between(uniform(seed + "opening", F.col("user_id")), *OPENING)
    return profiles.select("user_id", F.round(drawn, 2).alias("opening"))


def portfolios(profiles: DataFrame, as_of: Column, seed: str = "42") -> DataFrame:
    """Positions per user by income, with their values."""
    count = _banded(
        F.col("annual_income"),
        POSITIONS_BY_INCOME,
        lambda low, high: _whole(uniform(seed + "positions", F.col("user_id")), low, high),
    )
    rows = profiles.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), count)).alias("id"))

    def u(name: str) -> Column:
        return uniform(seed + name, F.col("user_id"), F.col("id"))

    rows = rows.withColumn("symbol", pick(u("symbol"), SECURITIES))
    symbol = F.col("symbol")
    coin, fund = symbol.isin(CRYPTO), symbol.isin(FUNDS)
    rows = rows.withColumns(
        {
            "asset_type": F.when(coin, "Cryptocurrency").when(fund, "ETF").otherwise("Stock"),
            "shares": F.when(coin, F.round(_between(u("shares"), 0.1, 10.0), 4))
            .when(fund, _whole(u("shares"), 1, 100).cast("double"))
            .otherwise(_whole(u("shares"), 1, 200).cast("double")),
            "current_price": F.round(
                F.when(coin, _between(u("price"), 100.0, 50000.0))
                .when(fund, _between(u("price"), 50.0, 500.0))
                .otherwise(_between(u("price"), 20.0, 3000.0)),
                2,
            ),
        }
    )
    rows = rows.withColumns(
        {
            "purchase_price": F.round(F.col("current_price") * _between(u("cost"), 0.7, 1.3), 2),
            "purchase_date": F.date_sub(as_of, _whole(u("bought"), 0, HISTORY_DAYS).cast("int")),
        }
    )
    return position_values(rows)


def sample_set(ids: DataFrame, as_of: Column, days: int, seed: str = "42") -> dict[str, DataFrame]:
    """Users, transactions with balances, monthly summaries and portfolios."""
    people = users(ids, as_of, seed)
    moves = transactions(people, as_of, days, seed)
    return {
        "users": people,
        "transactions": running_balance(moves, opening_balances(people, seed)),
        "monthly_summaries": monthly_summary(moves),
        "portfolios": portfolios(people, as_of, seed),
    }


def save_sample_set(tables: dict[str, DataFrame], path: str) -> None:
    """Writes each table; transactions are partitioned by month."""
    for name, df in tables.items():
        if name == "transactions":
            month = df.withColumn("month", F.date_format("date", "yyyy-MM")).hint("rebalance", "month")
            month.write.mode("overwrite").partitionBy("month").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
