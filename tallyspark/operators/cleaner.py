"""The whole cleaning run: rows, fills, outliers, formats, features, rules, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import anomaly, cleaning, quality
from tallyspark.plans.lineage import cut


def clean_financial_data(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    as_of: Column,
    target: str | None = None,
    formats: dict[str, str] | None = None,
    outlier_columns: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cleans a table; returns the rows and one row of quality scores.

    ``keys`` and ``order`` say which rows follow each other; they are neither filled
    nor treated as measurements.  Profiles are taken between steps, so the rows are
    checkpointed where a later step would repeat an earlier one.
    """
    rows, scores, _ = cleaned_with_counts(df, keys, order, as_of, target, formats, outlier_columns)
    return rows, scores


COUNTS = "place int, step string, counter string, n long"


def cleaned_with_counts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    as_of: Column,
    target: str | None = None,
    formats: dict[str, str] | None = None,
    outlier_columns: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``clean_financial_data``, and the counters (``place, step, counter, n``) that were observed while the rows flowed through its steps."""
    watches = {}

    def watched(rows: DataFrame, name: str) -> DataFrame:
        rows, watches[name] = cleaning.observed(rows, name)
        return rows

    rows = cut(watched(cleaning.basic_cleaning(watched(df, "rows in")), "basic cleaning"))
    rows = cut(cleaning.fill_missing(rows, keys, order))
    fixed = {*keys, *order}
    measured = outlier_columns or [c for c in cleaning.numeric_columns(rows) if c not in fixed]
    found: dict = {}
    rows = anomaly.handle_outliers(rows, measured, target, watches=found)
    rows = cut(watched(cleaning.standardise_formats(rows, formats), "outliers"))
    rows = cleaning.quality_columns(rows, keys, order)
    if "transaction_type" in rows.columns and "amount" in rows.columns:
        rows = cleaning.repair_signs(rows)
    rows = cut(watched(cleaning.drop_impossible_times(rows, as_of), "possible times"))
    named = [*watches.items(), *((f"outliers in {c}", w) for c, w in found.items())]
    counters = [(i, step, counter, int(n)) for i, (step, w) in enumerate(named) for counter, n in sorted(w.get.items())]
    before = int(watches["rows in"].get["rows"])
    return rows, quality.scores(rows, before, as_of), df.sparkSession.createDataFrame(counters, COUNTS)


def append_counts(counts: DataFrame, path: str, run: str) -> DataFrame:
    """Adds the counters of a run to a table of all runs and returns it."""
    counts.select(F.lit(run).alias("run"), "*").coalesce(1).write.mode("append").parquet(path)
    return counts.sparkSession.read.schema(f"run string, {COUNTS}").parquet(path)


def cleaning_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in, rows out and rows removed, as one row."""
    rows_in = before.select(F.count(F.lit(1))).scalar()
    return after.agg(F.count(F.lit(1)).alias("rows_out")).select(
        rows_in.alias("rows_in"), "rows_out", (rows_in - F.col("rows_out")).alias("rows_removed")
    )


def removed_by_kind(df: DataFrame, as_of: Column) -> DataFrame:
    """(step, rows_left, rows_removed) of the row-dropping steps, counted while the rows flow through all of them once."""
    steps = {
        "rows in": lambda d: d,
        "empty": cleaning.drop_empty_rows,
        "repeated": lambda d: d.dropDuplicates(),
        "zero": cleaning.drop_zero_rows,
        "impossible time": lambda d: cleaning.drop_impossible_times(d, as_of),
    }
    watches = {}
    for name, step in steps.items():
        df, watches[name] = cleaning.observed(step(df), name)
    df.write.format("noop").mode("overwrite").save()
    left = [(name, int(watch.get["rows"])) for name, watch in watches.items()]
    rows = [(name, n, before - n) for (name, n), before in zip(left, [left[0][1], *[n for _, n in left]])]
    return df.sparkSession.createDataFrame(rows, "step string, rows_left long, rows_removed long")

