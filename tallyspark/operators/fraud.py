"""Card-fraud features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import cut, safe_div
from tallyspark.plans.keyed import KeyedRows, any_of, table_quantiles, with_scalars

# Amount bins, risk ranges, risk weights and the V columns used.
AMOUNT_EDGES = [0, 10, 50, 200, 500, 2000, float("inf")]
RISK_WEIGHTS = {"high_risk_amount": 0.3, "is_night": 0.2, "is_weekend": 0.1, "amount_log": 0.4}
V_OUTLIER_COLUMNS = ["V1", "V2", "V3", "V4", "V7", "V10", "V11", "V12", "V14", "V16", "V17", "V18"]
V_PAIRS = [("V1", "V2"), ("V3", "V4"), ("V7", "V20"), ("V12", "V16")]
DAY = 86400


def time_features(tx: DataFrame, seconds: str = "time") -> DataFrame:
    t = F.col(seconds)
    hour = F.floor(F.pmod(t, F.lit(DAY)) / 3600)
    day = F.pmod(F.floor(t / DAY), F.lit(7))
    return tx.withColumns(
        {
            "hour": hour,
            "day_of_week": day,
            "is_weekend": (day >= 5).cast("int"),
            "is_night": ((hour >= 22) | (hour <= 6)).cast("int"),
        }
    )


def high_risk(amount: Column) -> Column:
    return any_of([amount < 5, (amount >= 100) & (amount <= 300), amount >= 2000]).cast("int")


def amount_features(tx: DataFrame, amount: str = "amount") -> DataFrame:
    a = F.col(amount)
    return tx.withColumns(
        {
            "amount_log": F.log1p(a),
            "amount_sqrt": F.sqrt(a),
            "amount_category": F.coalesce(cut(a, AMOUNT_EDGES, range(6)), F.lit(0)),
            "high_risk_amount": high_risk(a),
        }
    )


def amount_frequency(tx: DataFrame, amount: str = "amount") -> DataFrame:
    """How many rows share the amount; counts are pre-aggregated, popular amounts broadcast."""
    counts = tx.groupBy(amount).agg(F.count(F.lit(1)).alias("amount_frequency"))
    return KeyedRows(tx, [amount]).attach(counts)


def risk_scores(tx: DataFrame) -> DataFrame:
    """Weighted risk; the log amount counts relative to the table's largest."""
    top = tx.agg(F.max("amount_log").alias("_top"))
    w = RISK_WEIGHTS
    score = (
        sum((F.col(c) * w[c] for c in ("high_risk_amount", "is_night", "is_weekend")), F.lit(0.0))
        + safe_div(F.col("amount_log"), F.col("_top")) * w["amount_log"]
    )
    return with_scalars(tx, top).withColumn("risk_score", score).drop("_top")


def v_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("V") and c[1:].isdigit()]


def v_aggregates(df: DataFrame) -> DataFrame:
    """Sum, mean, sample deviation, maximum and minimum across the V columns of a row."""
    names = v_columns(df)
    values = F.array(*[F.col(c).cast("double") for c in names])
    total = sum((F.col(c) for c in names), F.lit(0.0))
    mean = total / len(names)
    squares = sum(((F.col(c) - F.col("v_mean")) * (F.col(c) - F.col("v_mean")) for c in names), F.lit(0.0))
    out = df.withColumns(
        {"v_sum": total, "v_mean": mean, "v_max": F.array_max(values), "v_min": F.array_min(values)}
    )
    return out.withColumn("v_std", F.sqrt(squares / (len(names) - 1)))


def v_interactions(df: DataFrame) -> DataFrame:
    """Products of column pairs; a missing column gives 0."""
    present = set(df.columns)
    return df.withColumns(
        {
            f"{a}_{b}_interaction": F.col(a) * F.col(b) if a in present and b in present else F.lit(0.0)
            for a, b in V_PAIRS
        }
    )


def v_outliers(df: DataFrame, columns: Sequence[str] = V_OUTLIER_COLUMNS) -> DataFrame:
    """1.5-IQR flags; all quartiles come from one pass."""
    present = [c for c in columns if c in df.columns]
    wanted = {}
    for c in present:
        wanted[f"_a_{c}"], wanted[f"_b_{c}"] = (c, 0.25), (c, 0.75)
    out = with_scalars(df, table_quantiles(df, wanted))

    def flag(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        reach = 1.5 * (b - a)
        return ((F.col(c) < a - reach) | (F.col(c) > b + reach)).cast("int")

    return out.withColumns({f"{c}_outlier": flag(c) for c in present}).drop(*wanted)


def card_features(tx: DataFrame) -> DataFrame:
    """All features of card rows that carry time and amount (V columns optional)."""
    out = risk_scores(amount_features(time_features(tx)))
    out = amount_frequency(out)
    if v_columns(tx):
        out = v_outliers(v_interactions(v_aggregates(out)))
    return out
