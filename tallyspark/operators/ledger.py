"""Transactions, balances, prices and positions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import safe_div
from tallyspark.plans.keyed import KeyedRows


def monthly_summary(tx: DataFrame) -> DataFrame:
    """Totals per user and month; expenses are negative amounts."""
    month = F.date_format("date", "yyyy-MM").alias("year_month")
    income = F.sum(F.when(F.col("type") == "Income", F.col("amount")).otherwise(0.0))
    expense = F.sum(F.when(F.col("type") == "Expense", F.col("amount")).otherwise(0.0))
    return (
        tx.groupBy("user_id", month)
        .agg(
            F.sum("amount").alias("total_amount"),
            F.count("amount").alias("transaction_count"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            income.alias("total_income"),
            expense.alias("total_expenses"),
        )
        .withColumn("net_savings", F.col("total_income") + F.col("total_expenses"))
    )


def monthly_summary_by_joins(tx: DataFrame) -> DataFrame:
    """The same income and expense columns as left joins of separate sums."""
    month = tx.withColumn("year_month", F.date_format("date", "yyyy-MM"))
    keys = ["user_id", "year_month"]

    def total(kind: str, name: str) -> DataFrame:
        return month.filter(F.col("type") == kind).groupBy(*keys).agg(F.sum("amount").alias(name))

    base = month.groupBy(*keys).agg(F.sum("amount").alias("total_amount"))
    joined = base.join(total("Income", "total_income"), keys, "left").join(
        total("Expense", "total_expenses"), keys, "left"
    )
    return joined.fillna(0.0, ["total_income", "total_expenses"])


def running_balance(tx: DataFrame, users: DataFrame) -> DataFrame:
    """Balance after each transaction, in (date, id) order, from an opening balance."""
    rows = KeyedRows(tx, ["user_id"], ["date", "id"])
    moved = rows.running({"moved": ("sum", F.col("amount"))})
    opening = rows.on(moved).attach(users.select("user_id", "opening"))
    return opening.withColumn("balance_after", F.coalesce("opening", F.lit(0.0)) + F.col("moved")).drop(
        "opening", "moved"
    )


def orphans(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows whose user does not exist."""
    return rows.join(users.select("user_id").distinct(), "user_id", "left_anti")


def latest_prices(updates: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key with the most recent update; extra columns follow it."""
    rest = [c for c in updates.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at]))
    return updates.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def upsert_prices(current: DataFrame, updates: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Current prices after applying updates; the later ``at`` wins per key."""
    return latest_prices(current.unionByName(updates), keys, at)


def fresh_prices(prices: DataFrame, as_of: Column, seconds: int = 300, at: str = "updated_at") -> DataFrame:
    """Prices written less than ``seconds`` before ``as_of``."""
    return prices.filter((F.col(at) > as_of - F.make_dt_interval(secs=F.lit(float(seconds)))) & (F.col(at) <= as_of))


def latest_days(
    prices: DataFrame, symbol: object, as_of: Column, days: int = 30, symbol_col: str = "symbol", date_col: str = "date"
) -> DataFrame:
    """The last ``days`` days of one symbol; sort at the point of use."""
    return prices.filter((F.col(symbol_col) == F.lit(symbol)) & (F.col(date_col) >= F.date_sub(as_of, days)))


# Days per named period.
PERIOD_DAYS = {
    "1d": 1, "5d": 5, "1mo": 30, "3mo": 90, "6mo": 180, "1y": 365, "2y": 730, "5y": 1825, "10y": 3650,
}


def in_period(ts: Column, period: str, as_of: Column) -> Column:
    """Condition for a named period ending at ``as_of``; unknown names keep all rows."""
    if period == "ytd":
        return ts >= F.date_trunc("year", as_of)
    if period in PERIOD_DAYS:
        return ts >= as_of - F.lit(timedelta(days=PERIOD_DAYS[period]))
    return F.lit(True)


def position_values(positions: DataFrame) -> DataFrame:
    """Value, total return and percentage return of each position, rounded to cents."""
    shares, cost, price = F.col("shares"), F.col("purchase_price"), F.col("current_price")
    return positions.withColumns(
        {
            "current_value": F.round(shares * price, 2),
            "total_return": F.round((price - cost) * shares, 2),
            "return_percentage": F.round(safe_div(price - cost, cost) * 100, 2),
        }
    )


def class_share(rows: DataFrame, label: str) -> DataFrame:
    """Rows per class and its share of the table."""
    total = rows.select(F.count(F.lit(1))).scalar()
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def table_statistics(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Row count per table and, where a symbol column is named, distinct symbols."""
    parts = [
        df.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
            (F.count_distinct(symbol) if symbol else F.lit(None).cast("long")).alias("symbols"),
        )
        for name, (df, symbol) in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
