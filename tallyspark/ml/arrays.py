"""Rows of features as numpy, and tables of tree nodes that tasks walk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.lineage import cut


def as_array(df: DataFrame, features: str) -> Column:
    """A vector or array column as an array of doubles."""
    return vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features).cast("array<double>")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """An Arrow list column as rows of numbers; a null number is NaN."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def scored(df: DataFrame, features: str, name: str, of) -> DataFrame:
    """Adds ``name``, the array that ``of`` (rows of features to rows of numbers) gives, a batch at a time."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(of(np.stack(x.to_numpy()))) if len(x) else [], dtype=object)

    return df.withColumn(name, run(as_array(df, features)))


PART_ROWS = 50_000


def few(df: DataFrame) -> DataFrame:
    """A checkpointed table in no more partitions than its rows need; a small one then adds up without an exchange."""
    kept = cut(df)
    return kept.coalesce(max(1, -(-kept.count() // PART_ROWS)))


FIT_ROWS, FIT_PARTS = 4_000, 24
SIDE_ROWS = 100_000


def dealt(df: DataFrame, side_by_side: bool = False) -> DataFrame:
    """Rows to fit trees on, which cost far more than their bytes tell: dealt out evenly, few rows to a partition while partitions are few.

    For fits that run side by side partitions are few instead: in a forest every partition sends the sums of all nodes, deep ones of a row or none.
    """
    rows = df.count()
    if side_by_side:
        return df.repartition(-(-rows // SIDE_ROWS)) if rows > FIT_ROWS else df
    parts = max(min(FIT_PARTS, -(-rows // FIT_ROWS)), -(-rows // PART_ROWS))
    return df.repartition(parts) if parts > 1 else df


def shares(total: np.ndarray) -> DenseVector:
    """Parts of the whole; all zero if there is none."""
    return DenseVector(total / total.sum() if total.sum() > 0 else total)
