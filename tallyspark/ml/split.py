"""Samples, folds and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import uniform
from tallyspark.plans.keyed import KeyedRows, ranked_values, with_scalars


def hash_number(seed: str, *parts: Column) -> Column:
    """Repeatable 52-bit number from a seed and the row's identity."""
    text = F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def positions(df: DataFrame, order: list[str], name: str = "_at") -> DataFrame:
    """0-based position in the whole table's order."""
    rows = KeyedRows(df.withColumn("_all", F.lit(0)), ["_all"], order)
    return rows.running({name: ("count", F.lit(1))}).withColumn(name, F.col(name) - 1).drop("_all")


def sample_rows(df: DataFrame, size: int, key: str, seed: str = "42") -> DataFrame:
    """Exactly ``size`` rows (all, if there are fewer), chosen by hash of the unique key.

    The hash of the last row taken is found by selection; only rows with that very hash are put in order of the key.
    """
    keyed = df.withColumn("_h", hash_number(seed, F.col(key)))
    counted = keyed.filter(F.col("_h").isNotNull())
    if size <= 0:
        return df.limit(0)
    if counted.limit(size + 1).count() <= size:
        return df
    last = int(ranked_values(counted, [("_h", size - 1)])[0])  # 52 bits, so exact as a double
    below = counted.filter(F.col("_h") < last)
    ties = counted.filter(F.col("_h") == last).orderBy(key).limit(size - below.count())
    return below.unionByName(ties).drop("_h")


def stratified_sample(df: DataFrame, size: int, label: str, key: str, seed: str = "42") -> DataFrame:
    """``size`` rows in two classes, keeping the share of class 1 (counts rounded down)."""
    share = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    placed = _ranked(df, label, key, seed)
    quota = F.floor(F.when(F.col(label) == 1, share * size).otherwise((1 - share) * size))
    return placed.filter(F.col("_at") <= quota).drop("_at")


def _ranked(df: DataFrame, label: str, key: str, seed: str) -> DataFrame:
    hashed = df.withColumn("_h", hash_number(seed, F.col(key)))
    return KeyedRows(hashed, [label], ["_h", key]).running({"_at": ("count", F.lit(1))}).drop("_h")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: str = "42") -> DataFrame:
    """Adds ``fold`` so that every class is spread evenly; fold 0 of 5 is a 20 % test set."""
    placed = _ranked(df, label, key, seed)
    return placed.withColumn("fold", F.pmod(F.col("_at") - 1, F.lit(folds)).cast("int")).drop("_at")


def hash_folds(df: DataFrame, key: str, folds: int, seed: str = "42") -> DataFrame:
    """Adds ``fold`` from the key alone: no shuffle, about even."""
    return df.withColumn("fold", F.floor(uniform(seed, F.col(key)) * folds).cast("int"))


def time_folds(df: DataFrame, order: list[str], folds: int = 5) -> DataFrame:
    """Adds ``test_fold`` 1..folds for expanding-window validation, 0 for the first part.

    The test part of fold i is trained on all rows with a smaller ``test_fold``.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    size = F.floor(total / (folds + 1))
    start = total - size * folds
    at = F.col("_at")
    fold = F.when(at < start, 0).otherwise(F.floor((at - start) / size) + 1)
    return positions(df, order).withColumn("test_fold", fold.cast("int")).drop("_at")


def time_split(df: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """Adds ``is_test``: the rows after the first ``share`` in time order."""
    total = df.select(F.count(F.lit(1))).scalar()
    return positions(df, order).withColumn("is_test", F.col("_at") >= F.floor(total * share)).drop("_at")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """One row per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    return with_scalars(counts, totals).select(
        label, (F.col("_rows") / (F.col("_classes") * F.col("_n"))).alias("weight")
    )


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    return KeyedRows(df, [label]).attach(class_weights(df, label))


def with_positive_weight(df: DataFrame, label: str, weight: float) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, float(weight)).otherwise(1.0))
