"""Queries over transactions, prices and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import ledger
from tallyspark.queries.registry import query
from tallyspark.sources import views
from tallyspark.sources.tables import table
from tallyspark.sources.views import ORDERS_AS_OF


def money(*names):
    return {n: F.round(n, 2) for n in names}


@query(
    "A1",
    views="transactions",
    sql="""
SELECT user_id, strftime(date, '%Y-%m') AS year_month, round(sum(amount), 2) AS total_amount,
       count(amount) AS transaction_count, min(date) AS first_date, max(date) AS last_date,
       round(sum(CASE WHEN type = 'Income' THEN amount ELSE 0 END), 2) AS total_income,
       round(sum(CASE WHEN type = 'Expense' THEN amount ELSE 0 END), 2) AS total_expenses,
       round(sum(amount), 2) AS net_savings
FROM transactions GROUP BY 1, 2
""",
)
def monthly_summary(spark, folder):
    out = ledger.monthly_summary(views.transactions(spark, folder))
    return out.withColumns(money("total_amount", "total_income", "total_expenses", "net_savings"))


@query(
    "J1",
    views="transactions",
    sql="""
WITH m AS (SELECT *, strftime(date, '%Y-%m') AS year_month FROM transactions),
base AS (SELECT user_id, year_month, sum(amount) AS total_amount FROM m GROUP BY 1, 2),
inc AS (SELECT user_id, year_month, sum(amount) AS x FROM m WHERE type = 'Income' GROUP BY 1, 2),
exp AS (SELECT user_id, year_month, sum(amount) AS x FROM m WHERE type = 'Expense' GROUP BY 1, 2)
SELECT base.user_id, base.year_month, round(total_amount, 2) AS total_amount,
       round(coalesce(inc.x, 0), 2) AS total_income, round(coalesce(exp.x, 0), 2) AS total_expenses
FROM base LEFT JOIN inc ON base.user_id = inc.user_id AND base.year_month = inc.year_month
LEFT JOIN exp ON base.user_id = exp.user_id AND base.year_month = exp.year_month
""",
)
def monthly_summary_joined(spark, folder):
    out = ledger.monthly_summary_by_joins(views.transactions(spark, folder))
    return out.withColumns(money("total_amount", "total_income", "total_expenses"))


@query(
    "W1",
    views="transactions users",
    sql="""
SELECT t.id, t.user_id, t.date, t.amount,
       round(coalesce(u.opening, 0) + sum(t.amount) OVER (PARTITION BY t.user_id ORDER BY t.date, t.id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS balance_after
FROM transactions t LEFT JOIN users u ON t.user_id = u.user_id
""",
)
def running_balance(spark, folder):
    tx = views.transactions(spark, folder).select("id", "user_id", "date", "amount")
    return ledger.running_balance(tx, views.users(spark, folder)).withColumns(money("balance_after"))


@query(
    "J10",
    views="transactions users",
    sql="""
SELECT t.id, t.user_id + 1 AS user_id, t.amount FROM transactions t
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = t.user_id + 1)
""",
)
def orphan_transactions(spark, folder):
    """User ids are moved by one, so the last user's rows have no user."""
    tx = views.transactions(spark, folder).select("id", (F.col("user_id") + 1).alias("user_id"), "amount")
    return ledger.orphans(tx, views.users(spark, folder)).select("id", "user_id", "amount")


@query(
    "S8",
    sql="""
WITH u AS (
  SELECT l_partkey AS symbol, l_returnflag AS asset_type, l_extendedprice / l_quantity AS price,
         l_shipdate AS updated_at, l_orderkey, l_linenumber FROM lineitem
  UNION ALL
  SELECT p_partkey, f.x, p_retailprice, TIMESTAMP '1998-01-01', -1, -1 FROM part, (VALUES ('A'), ('N'), ('R')) f(x))
SELECT symbol, asset_type, price, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, asset_type ORDER BY updated_at DESC, price DESC) AS r FROM u) WHERE r = 1
""",
)
def upsert_current_prices(spark, folder):
    updates = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("symbol"),
        F.col("l_returnflag").alias("asset_type"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("updated_at"),
    )
    current = table(spark, folder, "part").select(
        F.col("p_partkey").alias("symbol"),
        F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("asset_type"),
        F.col("p_retailprice").alias("price"),
        F.lit("1998-01-01").cast("timestamp_ntz").alias("updated_at"),
    )
    return ledger.upsert_prices(current, updates, ["symbol", "asset_type"], "updated_at")


@query(
    "R11",
    sql=f"""
WITH u AS (SELECT event_type AS symbol, user_id, arg_max(value, ts) AS price, max(ts) AS updated_at FROM events GROUP BY 1, 2)
SELECT 'token' AS kind, symbol, user_id, price, updated_at FROM u
WHERE updated_at > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 300 SECOND AND updated_at <= TIMESTAMP '2024-01-30 00:00:00'
UNION ALL
SELECT 'nft' AS kind, symbol, user_id, price, updated_at FROM u
WHERE updated_at > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 3600 SECOND AND updated_at <= TIMESTAMP '2024-01-30 00:00:00'
""",
)
def fresh_prices(spark, folder):
    """Token prices live 300 s, collection data 3600 s."""
    updates = table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), "user_id", F.col("value").alias("price"), F.col("ts").alias("updated_at")
    )
    latest = ledger.latest_prices(updates, ["symbol", "user_id"], "updated_at")
    as_of = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")

    def alive(kind, seconds):
        return ledger.fresh_prices(latest, as_of, seconds).select(
            F.lit(kind).alias("kind"), "symbol", "user_id", "price", "updated_at"
        )

    return alive("token", 300).unionByName(alive("nft", 3600))


@query(
    "S9 S6",
    views="transactions",
    sql=f"""
SELECT id, user_id, date, amount FROM transactions
WHERE user_id = 42 AND date >= CAST(TIMESTAMP '{ORDERS_AS_OF}' AS DATE) - 900 ORDER BY date, id
""",
)
def latest_days_of_user(spark, folder):
    as_of = F.to_date(F.lit(ORDERS_AS_OF))
    tx = views.transactions(spark, folder).select("id", "user_id", "date", "amount")
    return ledger.latest_days(tx, 42, as_of, 900, symbol_col="user_id").orderBy("date", "id")


@query(
    "S6",
    views="transactions",
    sql="""
SELECT id, user_id, category, amount FROM transactions WHERE category = '1-URGENT' AND amount < -400000
""",
)
def read_with_bound_parameters(spark, folder):
    tx = views.transactions(spark, folder)
    return spark.sql(
        "SELECT id, user_id, category, amount FROM {tx} WHERE category = :category AND amount < :amount",
        args={"category": "1-URGENT", "amount": -400000.0},
        tx=tx,
    )


_PERIODS = ["1d", "5d", "1mo", "3mo", "6mo", "1y", "2y", "5y", "10y", "ytd", "max"]


@query(
    "S13",
    views="transactions",
    sql=" UNION ALL ".join(
        [
            f"SELECT '{p}' AS period, count(*) AS n, round(sum(amount), 2) AS total FROM transactions"
            f" WHERE date >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL {ledger.PERIOD_DAYS[p]} DAY"
            for p in _PERIODS
            if p in ledger.PERIOD_DAYS
        ]
        + [
            f"SELECT 'ytd', count(*), round(sum(amount), 2) FROM transactions WHERE date >= date_trunc('year', TIMESTAMP '{ORDERS_AS_OF}')",
            "SELECT 'max', count(*), round(sum(amount), 2) FROM transactions",
        ]
    ),
)
def totals_by_period(spark, folder):
    """One pass: each row joins the periods it belongs to."""
    as_of = F.lit(ORDERS_AS_OF).cast("timestamp_ntz")
    tx = views.transactions(spark, folder).select("date", "amount")
    aggs = []
    for p in _PERIODS:
        inside = ledger.in_period(F.col("date"), p, as_of)
        aggs.append(
            F.struct(
                F.lit(p).alias("period"),
                F.count_if(inside).alias("n"),
                F.round(F.sum(F.when(inside, F.col("amount"))), 2).alias("total"),
            )
        )
    return tx.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


@query(
    "S11",
    sql="""
SELECT 'users' AS table_name, count(*) AS row_count, NULL::BIGINT AS symbols FROM customer
UNION ALL SELECT 'transactions', count(*), NULL FROM orders
UNION ALL SELECT 'monthly_summaries', count(DISTINCT (o_custkey, date_trunc('month', o_orderdate))), NULL FROM orders
UNION ALL SELECT 'portfolios', count(*), count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'stock_data', count(*), count(DISTINCT event_type) FROM events
UNION ALL SELECT 'crypto_data', count(*), count(DISTINCT label) FROM embeddings
UNION ALL SELECT 'current_prices', count(*), count(DISTINCT p_partkey) FROM part
""",
)
def table_statistics(spark, folder):
    summaries = (
        views.transactions(spark, folder).select("user_id", F.date_format("date", "yyyy-MM").alias("m")).distinct()
    )
    return ledger.table_statistics(
        {
            "users": (table(spark, folder, "customer"), None),
            "transactions": (table(spark, folder, "orders"), None),
            "monthly_summaries": (summaries, None),
            "portfolios": (table(spark, folder, "lineitem"), "l_partkey"),
            "stock_data": (table(spark, folder, "events"), "event_type"),
            "crypto_data": (table(spark, folder, "embeddings"), "label"),
            "current_prices": (table(spark, folder, "part"), "p_partkey"),
        }
    )


@query(
    "P20",
    views="holdings",
    sql="""
SELECT user_id, symbol, purchase_date, shares, round(shares * current_price, 2) AS current_value,
       round((current_price - purchase_price) * shares, 2) AS total_return,
       round((current_price - purchase_price) / nullif(purchase_price, 0) * 100, 2) AS return_percentage
FROM holdings
""",
)
def position_values(spark, folder):
    out = ledger.position_values(views.holdings(spark, folder))
    return out.select(
        "user_id", "symbol", "purchase_date", "shares", "current_value", "total_return", "return_percentage"
    )


@query(
    "A10",
    views="transactions",
    sql="""
SELECT category, count(*) AS n, count(*) / (SELECT count(*) FROM transactions) AS share FROM transactions GROUP BY 1
""",
)
def category_distribution(spark, folder):
    return ledger.class_share(views.transactions(spark, folder), "category")


@query(
    "A10",
    views="bars",
    sql="""
SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, min(ts) AS first_ts, max(ts) AS last_ts FROM bars
""",
)
def bar_coverage(spark, folder):
    return views.bars(spark, folder).agg(
        F.count("*").alias("n"),
        F.count_distinct("symbol").alias("symbols"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
