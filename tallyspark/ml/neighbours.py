"""Exact nearest neighbours and minority oversampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.exprs import uniform
from tallyspark.ml.split import positions
from tallyspark.plans.lineage import cut

BLOCK_ROWS = 4_000
CHUNK_ROWS = 256
MOST_PIVOTS = 512


class Cells:
    """Pivots, and for each block of the rows nearest to one of them the span of their distances to it.

    At most ``MOST_PIVOTS`` pivots; a crowded cell is several blocks with the cell's span, told apart by number only.
    """

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.low = self.high = np.zeros(len(pivots))
        self.parts = np.ones(len(pivots), int)

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def reached(self, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which cells may hold a row within ``reach`` of each row, by the triangle inequality."""
        d = self.distances(x)
        gap = np.maximum(d - self.high, self.low - d)
        # Distances by the expanded square are off by about the root of the machine's precision.
        slack = 1e-6 * (1 + np.sqrt((x**2).sum(1)) + np.sqrt((self.pivots**2).sum(1).max(initial=0)))
        return gap <= (reach + slack)[:, None]


def _rows(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def _in_cells(base: DataFrame, block_rows: int) -> tuple[DataFrame, Cells]:
    """(key, f, cell, block) of all rows, and the cells; the driver gets the pivots and one row per cell."""
    count = min(MOST_PIVOTS, max(1, math.ceil(base.count() / block_rows)))
    sample = base.orderBy(uniform("pivot", F.col("key")), "key").limit(count).select("f").toPandas()
    cells = Cells(np.unique(np.vstack(sample["f"].to_numpy()), axis=0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = cells.distances(np.vstack(batch["f"].to_numpy()))
                own = d.argmin(1)
                yield batch.assign(cell=own, away=d[np.arange(len(own)), own])

    placed = cut(base.mapInPandas(place, f"{_rows(base)}, cell int, away double"))
    seen = placed.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n")).toPandas()
    size = len(cells.pivots)
    cells.low, cells.high, cells.parts = np.full(size, np.inf), np.full(size, -np.inf), np.zeros(size, int)
    cells.low[seen["cell"]], cells.high[seen["cell"]] = seen["low"], seen["high"]
    cells.parts[seen["cell"]] = np.ceil(seen["n"] / block_rows)
    first = np.append(0, np.cumsum(cells.parts)).tolist()
    start, parts = (F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("cell")) for values in (first, np.maximum(cells.parts, 1)))
    block = start + F.floor(uniform("part", F.col("key")) * parts).cast("int")
    return placed.select("key", "f", "cell", block.cast("int").alias("block")), cells


def _best(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of ``b`` for each row of ``a``, itself left out."""
    if a.empty or b.empty:
        return pd.DataFrame({"key": [], "neighbour": [], "distance": []})
    x, y = np.vstack(a["f"].to_numpy()), np.vstack(b["f"].to_numpy())
    ids, others = a["key"].to_numpy(), b["key"].to_numpy()
    take = min(len(others), k)
    keys, found, dist = [], [], []
    for i in range(0, len(x), CHUNK_ROWS):
        part = x[i : i + CHUNK_ROWS]
        size = (part**2).sum(1)[:, None] + (y**2).sum(1)[None, :]
        rough = size - 2 * part @ y.T
        rough[others == ids[i : i + CHUNK_ROWS, None]] = np.inf
        # Rounding moves a squared distance by less than this; all that may be among the
        # k best stay, however many are equally far.
        error = 8 * x.shape[1] * np.finfo(float).eps * size.max(1)
        last = np.partition(rough, take - 1, axis=1)[:, take - 1]
        for j, limit in enumerate(last + 2 * error):
            near = np.flatnonzero(rough[j] <= limit) if np.isfinite(limit) else np.flatnonzero(np.isfinite(rough[j]))
            exact = np.sqrt(((part[j] - y[near]) ** 2).sum(1))
            best = np.lexsort((others[near], exact))[:k]
            keys.append(np.full(len(best), ids[i + j]))
            found.append(others[near[best]])
            dist.append(exact[best])
    return pd.DataFrame({"key": np.concatenate(keys), "neighbour": np.concatenate(found), "distance": np.concatenate(dist)})


FOUND = "key long, neighbour long, distance double"


def further_blocks(rows: DataFrame, own: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(key, f, l, r): the blocks r, besides its own l, that may hold one of a row's k nearest."""
    reach = own.groupBy("key").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("reach"))
    first = np.append(0, np.cumsum(cells.parts))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), CHUNK_ROWS):
                part = batch.iloc[i : i + CHUNK_ROWS]
                row, cell = np.nonzero(cells.reached(np.vstack(part["f"].to_numpy()), part["reach"].to_numpy()))
                many = cells.parts[cell]
                at = np.repeat(np.arange(len(row)), many)
                r = first[cell][at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                out = part.iloc[row[at]][["key", "f", "block"]].rename(columns={"block": "l"}).assign(r=r)
                yield out[out["l"] != out["r"]]

    asked = rows.join(reach, "key", "left").fillna(float("inf"), ["reach"]).drop("cell")
    return asked.mapInPandas(ask, "key long, f array<double>, l int, r int")


def nearest(df: DataFrame, key: str, features: str, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest other rows of each row: (key, neighbour, distance, rank).

    Rows go to the cell of their nearest pivot, cells are blocks of bounded size. The k best of a row's own block bound
    how far its neighbours can be; only blocks that reach into that distance are visited, by the rows they matter to.
    A pair of blocks is one task that returns only the k best per row, so no pairs of rows are materialised.
    """
    base = df.select(F.col(key).cast("long").alias("key"), F.col(features).cast("array<double>").alias("f"))
    if base.isEmpty():
        return base.select("key", F.col("key").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    rows, cells = _in_cells(base, block_rows)
    own = cut(rows.groupBy("block").applyInPandas(lambda part: _best(part, part, k), FOUND))
    asked = cut(further_blocks(rows, own, cells, k))
    visited = asked.select(F.col("l").alias("l"), F.col("r").alias("r")).distinct()
    there = visited.join(rows.select("key", "f", F.col("block").alias("r")), "r")
    other = asked.groupBy("l", "r").cogroup(there.groupBy("l", "r")).applyInPandas(lambda a, b: _best(a, b, k), FOUND)
    w = Window.partitionBy("key").orderBy("distance", "neighbour")
    return own.union(other).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def oversample(
    df: DataFrame, label: str, key: str, features: list[str], minority: int = 1, k: int = 5, seed: str = "42"
) -> DataFrame:
    """Synthetic minority rows that bring the class up to the size of the other.

    Row j starts from minority row j mod m (in key order), moves a repeatable uniform
    share of the way to one of its k nearest minority rows.
    """
    few = df.filter(F.col(label) == minority).select(
        F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in features]).alias("f")
    )
    counts = df.agg(
        F.count_if(F.col(label) == minority).alias("m"), F.count_if(F.col(label) != minority).alias("n")
    ).first()
    wanted = max(0, counts["n"] - counts["m"])
    ranked = positions(few, ["key"], "at")
    share, rest = divmod(wanted, counts["m"]) if counts["m"] else (0, 0)
    copies = F.lit(share) + F.when(F.col("at") < rest, 1).otherwise(0)
    drawn = (
        ranked.filter(copies > 0)
        .select("key", "f", "at", F.explode(F.sequence(F.lit(0), copies - 1)).alias("turn"))
        .withColumn("j", F.col("turn") * counts["m"] + F.col("at"))
    )
    sizes = nearest(few, "key", "f", k)
    held = min(k, max(counts["m"] - 1, 1))
    drawn = drawn.withColumns(
        {
            "rank": F.floor(uniform(seed + "n", F.col("j")) * held).cast("int") + 1,
            "gap": uniform(seed + "g", F.col("j")),
        }
    )
    other = few.select(F.col("key").alias("neighbour"), F.col("f").alias("g"))
    joined = drawn.join(sizes.select("key", "neighbour", "rank"), ["key", "rank"]).join(other, "neighbour")
    moved = F.zip_with("f", "g", lambda a, b: a + F.col("gap") * (b - a))
    out = joined.withColumn("x", moved)
    return out.select(
        F.col("j").alias("sample"),
        "key",
        "neighbour",
        F.lit(minority).alias(label),
        *[F.element_at("x", i + 1).alias(c) for i, c in enumerate(features)],
    )
