"""A bounded sample of labelled documents, the same on every run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int, id: str, text: str, label: str) -> DataFrame:
    """``y`` (0 or 1), ``k`` (a number per document) and ``text`` of the first ``per_class`` ids of each class by a hash.

    ``learn`` is a condition on ``id``. The ids are chosen from the labels alone, so no text is shuffled to find them, and at
    most ``2 * per_class`` ids are broadcast. Of several labels of an id the larger counts, of several texts the smallest.
    """
    known = labels.filter(learn & F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(id).agg(F.max(label).cast("int").alias("y"))
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64(id), id).limit(per_class) for y in (0, 1)]
    ids = F.broadcast(reduce(DataFrame.union, chosen))
    found = docs.select(F.col(id), F.col(text).cast("string").alias("text")).join(ids, id)
    one = found.groupBy(id).agg(F.first("y").alias("y"), F.min("text").alias("text"))
    return one.select("y", F.xxhash64(id).alias("k"), "text")
