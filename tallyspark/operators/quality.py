"""Data-quality scores of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.cleaning import numeric_columns, string_columns, time_columns
from tallyspark.plans.keyed import table_quantiles, with_scalars


def completeness(df: DataFrame) -> Column:
    cells = F.count(F.lit(1)) * len(df.columns)
    filled = sum((F.count(c) for c in df.columns), F.lit(0))
    return F.coalesce(F.try_divide(filled, cells), F.lit(0.0)).alias("completeness")


def accuracy(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Share of cells that pass their rule; the default rule is 3 IQR around the quartiles.

    The divisor counts all columns, so text cells never count as accurate.
    """
    cells = F.count(F.lit(1)) * len(df.columns)
    if rules:
        passed = [F.count_if(rule) for c, rule in rules.items() if c in df.columns]
        return df.agg(F.try_divide(sum(passed, F.lit(0)), cells).alias("accuracy"))
    numbers = numeric_columns(df)
    if not numbers:
        return df.agg(F.lit(0.0).alias("accuracy"))
    wanted = {}
    for c in numbers:
        wanted[f"_q1_{c}"], wanted[f"_q3_{c}"] = (c, 0.25), (c, 0.75)
    rows = with_scalars(df, table_quantiles(df, wanted))
    passed = []
    for c in numbers:
        q1, q3 = F.col(f"_q1_{c}"), F.col(f"_q3_{c}")
        reach = 3 * (q3 - q1)
        passed.append(F.count_if((F.col(c) >= q1 - reach) & (F.col(c) <= q3 + reach)))
    return rows.agg(F.coalesce(F.try_divide(sum(passed, F.lit(0)), cells), F.lit(0.0)).alias("accuracy"))


def duplicate_share(df: DataFrame) -> DataFrame:
    """One row: rows that repeat an earlier row, as a share of all rows."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.try_divide(F.sum(F.col("_n") - 1), F.sum("_n")), F.lit(0.0)).alias("duplicates"))


def scores(df: DataFrame, original_rows: int, as_of: Column, rules: dict[str, Column] | None = None) -> DataFrame:
    """One row with the six scores, their mean and the level.

    ``original_rows`` is the row count before cleaning.
    """
    texts, times = string_columns(df), time_columns(df)
    n = F.count(F.lit(1))
    aggs = [n.alias("rows"), completeness(df)]
    for i, c in enumerate(texts):
        aggs += [F.count_distinct(F.length(c)).alias(f"_p{i}"), F.count(c).alias(f"_c{i}")]
    if times:
        newest = F.max(F.col(times[0]).cast("timestamp"))
        age = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(newest)) / F.lit(86_400_000_000))
        aggs.append(F.greatest(F.lit(0.0), 1 - F.coalesce(age, F.lit(365)) / 30.0).alias("timeliness"))
    else:
        aggs.append(F.lit(1.0).alias("timeliness"))
    one = df.agg(*aggs)
    one = with_scalars(one, accuracy(df, rules))
    one = with_scalars(one, duplicate_share(df))
    ragged = sum(
        (F.when(F.col(f"_p{i}") > F.col(f"_c{i}") * 0.5, 0.1).otherwise(0.0) for i in range(len(texts))), F.lit(0.0)
    )
    one = one.withColumns(
        {
            "consistency": F.greatest(F.lit(0.0), 1 - 0.3 * F.col("duplicates") - ragged),
            "validity": F.coalesce(F.try_divide(F.col("rows"), F.lit(original_rows)), F.lit(0.0)),
            "uniqueness": 1 - F.col("duplicates"),
        }
    )
    names = ["completeness", "accuracy", "consistency", "validity", "uniqueness", "timeliness"]
    return with_level(one.select(*[F.col(c).cast("double") for c in names]), names)


def with_level(df: DataFrame, names: list[str]) -> DataFrame:
    """Overall score (mean of the scores above 0) and its level."""
    positive = F.filter(F.array(*names), lambda s: s > 0)
    mean = F.try_divide(F.aggregate(positive, F.lit(0.0), lambda a, s: a + s), F.size(positive).cast("double"))
    level = (
        F.when(F.col("overall") >= 0.9, "excellent")
        .when(F.col("overall") >= 0.8, "good")
        .when(F.col("overall") >= 0.7, "fair")
        .when(F.col("overall") >= 0.6, "poor")
        .otherwise("critical")
    )
    return df.withColumn("overall", mean).withColumn("level", level)
