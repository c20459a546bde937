"""Isolation forest, and its vote with density noise."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.exprs import uniform
from tallyspark.operators.anomaly import density_noise, robust_scaled
from tallyspark.plans.keyed import table_quantiles, with_scalars
from tallyspark.plans.lineage import cut
from tallyspark.sources.tables import spread

# Forest size, rows per tree, share of anomalies, least rows to fit.
TREES, TREE_ROWS, CONTAMINATION, LEAST_ROWS = 100, 256, 0.1, 50
NODE_SCHEMA = "tree int, node int, feature int, at double, left int, right int, length double"


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, threshold, left, right, path length); leaves have feature -1."""
    deepest = math.ceil(math.log2(max(len(rows), 2)))
    nodes: list[tuple] = [()]
    todo = [(0, rows, 0)]
    while todo:
        at, part, depth = todo.pop()
        spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
        if depth >= deepest or len(spread) == 0:
            nodes[at] = (-1, 0.0, -1, -1, depth + mean_path(len(part)))
            continue
        feature = int(rng.choice(spread))
        column = part[:, feature]
        border = float(rng.uniform(column.min(), column.max()))
        below = column <= border
        left, right = len(nodes), len(nodes) + 1
        nodes[at] = (feature, border, left, right, 0.0)
        nodes += [(), ()]
        todo += [(left, part[below], depth + 1), (right, part[~below], depth + 1)]
    return nodes


def fit_forest(df: DataFrame, features: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """One row per tree node: at most TREES * (2 * TREE_ROWS - 1) rows, whatever the table.

    A hash keeps a pool of rows sized for the forest; each tree takes the rows with
    the smallest hashes of its own.
    """
    names = list(features)
    total = df.select(F.count(F.lit(1))).scalar()
    pool_share = F.lit(4.0 * TREES * TREE_ROWS) / total
    pool = df.select(key, *names).filter(uniform(f"pool{seed}", F.col(key)) < pool_share)
    spread = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    spread = spread.withColumn("_u", uniform(f"tree{seed}", F.col("tree"), F.col(key)))
    # A tree needs the smallest of the pool's hashes only; four times as many are ample.
    spread = spread.filter(F.col("_u") < F.greatest(F.lit(4.0 * TREE_ROWS) / total, F.lit(1.0 / TREES)))
    own = Window.partitionBy("tree").orderBy("_u", key)
    chosen = spread.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= TREE_ROWS)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        tree = int(part["tree"].iloc[0])
        nodes = grow(part[names].to_numpy(float), np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["feature", "at", "left", "right", "length"])
        return out.assign(tree=tree, node=np.arange(len(out)))[["tree", "node", "feature", "at", "left", "right", "length"]]

    return chosen.groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def walked(x: np.ndarray, trees: Sequence[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Path lengths of rows of features, added up over the trees."""
    total = np.zeros(len(x))
    for feature, at, left, right, length in trees:
        node = np.zeros(len(x), int)
        inner = feature[node] >= 0
        while inner.any():
            f = feature[node]
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= at[node]
            node = np.where(inner, np.where(low, left[node], right[node]), node)
            inner = feature[node] >= 0
        total += length[node]
    return total


def steps(trees: Sequence[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The added path lengths over a single feature, a step function: upper ends of all steps but the last, and the length on each."""
    ends = np.unique(np.concatenate([at[feature >= 0] for feature, at, *_ in trees]))
    return ends, walked(np.append(ends, np.inf)[:, None], trees)


def score_forest(df: DataFrame, nodes: DataFrame, features: Sequence[str], name: str = "iso_score") -> DataFrame:
    """Adds the score 2^(-mean path / expected path); higher is more isolated.

    Rows of one feature are looked up among the forest's steps, others walk down every tree.
    """
    names = list(features)
    # The model has a fixed upper size, so it may travel through the driver.
    model = nodes.orderBy("tree", "node").toPandas()
    trees = [
        (g["feature"].to_numpy(), g["at"].to_numpy(), g["left"].to_numpy(), g["right"].to_numpy(), g["length"].to_numpy())
        for _, g in model.groupby("tree")
    ]
    single = len(names) == 1 and len(trees) > 0
    shared = df.sparkSession.sparkContext.broadcast(steps(trees) if single else trees)
    count, expected = len(trees), mean_path(TREE_ROWS)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for batch in batches:
            x = batch[names].to_numpy(float)
            # NaN takes the last step, as it goes right at every node.
            total = held[1][np.searchsorted(held[0], x[:, 0])] if single else walked(x, held)
            yield batch.assign(**{name: 2 ** (-(total / count) / expected)})

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {name} double"
    return spread(df).mapInPandas(score, schema)


def isolation_flags(df: DataFrame, features: Sequence[str], key: str, name: str = "isolated") -> DataFrame:
    """Flags the tenth of rows with the highest scores; none below 50 rows, where the score is null."""
    if df.limit(LEAST_ROWS).count() < LEAST_ROWS:
        return df.withColumns({"iso_score": F.lit(None).cast("double"), name: F.lit(False)})
    # The limit is selected in several passes and the flags are read again, so rows are scored once.
    scored = cut(score_forest(df, fit_forest(df, features, key), features))
    limit = table_quantiles(scored, {"_limit": ("iso_score", 1 - CONTAMINATION)})
    return with_scalars(scored, limit).withColumn(name, F.col("iso_score") > F.col("_limit")).drop("_limit")


def forest_and_noise(df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds ``anomaly``: isolated and noise at once, on the robust-scaled value."""
    known = robust_scaled(df.filter(F.col(value).isNotNull()), [], value, "_scaled")
    flagged = density_noise(isolation_flags(known, ["_scaled"], key), [], "_scaled", name="_noise")
    return flagged.withColumn("anomaly", F.col("isolated") & F.col("_noise")).select(*df.columns, "anomaly")
