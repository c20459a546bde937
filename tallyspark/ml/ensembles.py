"""Voting and stacking over MLlib models and this package's own."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.ml.arrays import dealt
from tallyspark.ml.boosting import BoostedModel, Booster
from tallyspark.ml.kernel import KernelMachine, KernelModel
from tallyspark.ml.random_trees import ExtraTrees, ForestModel
from tallyspark.ml.split import hash_folds
from tallyspark.plans.lineage import cut

OWN_MODELS = (BoostedModel, ForestModel, KernelModel)
PENALTY = 0.1  # L1 and L2 of boosting
FITS_AT_ONCE, ROWS_AT_ONCE = 6, 400_000  # fits side by side, and the rows that all of them read


class _WithoutSummary:
    """An estimator of MLlib whose models leave out the training summary, which holds the session; a session that has observed a table cannot go to the tasks."""

    def _create_model(self, java_model):
        return super()._create_model(java_model.setSummary(SparkSession.active()._jvm.scala.Option.empty()))


class Forest(_WithoutSummary, RandomForestClassifier):
    pass


class Logistic(_WithoutSummary, LogisticRegression):
    pass


class Linear(_WithoutSummary, LinearSVC):
    pass


def random_forest(label: str, features: str, trees: int = 100, depth: int = 10, weight: str | None = None, seed: int = 42):
    model = Forest(
        labelCol=label, featuresCol=features, numTrees=trees, maxDepth=depth, minInstancesPerNode=2,
        featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True,  # else the driver sends all trees out again at every level
    )
    return model.setWeightCol(weight) if weight else model


def extra_trees(label: str, features: str, trees: int = 150, depth: int = 12, seed: int = 43) -> ExtraTrees:
    return ExtraTrees(label, features, trees, depth, seed=seed)


def boosted_trees(label: str, features: str, rounds: int = 100, depth: int = 6, weight: str | None = None, penalty: float = PENALTY, positive_weight: float = 1.0, seed: int = 42) -> Booster:
    return Booster(label, features, rounds=rounds, depth=depth, l1=penalty, l2=penalty, weight=weight, positive_weight=positive_weight, seed=seed)


def boosted_trees_many(label: str, features: str, rounds: int = 80, depth: int = 6, classes: int = 2, penalty: float = PENALTY, seed: int = 42) -> Booster:
    """Boosting for any number of classes, one tree per class and round."""
    return Booster(label, features, rounds=rounds, depth=depth, l1=penalty, l2=penalty, classes=classes, bins=32, seed=seed)


def kernel_machine(label: str, features: str, landmarks: int = 100, penalty: float = 1.0, rounds: int = 100) -> KernelMachine:
    return KernelMachine(label, features, landmarks, penalty, rounds=rounds)


def linear_svc(label: str, features: str, rounds: int = 50):
    """A linear machine; its margin becomes a probability by the logistic function."""
    return Linear(labelCol=label, featuresCol=features, regParam=0.01, maxIter=rounds)


def logistic(label: str, features: str, reg: float = 0.01):
    return Logistic(labelCol=label, featuresCol=features, regParam=reg, maxIter=100)


def without_summary(model):
    """The model without its training summary, see ``_WithoutSummary``."""
    return model.copy() if getattr(model, "hasSummary", False) else model


def class_probabilities(model, df: DataFrame, name: str) -> DataFrame:
    """Adds class probabilities of a fitted model as an array, and nothing else.

    Linear models of two classes are scored from their coefficients alone: the plan then holds numbers, not a model.
    """
    if hasattr(model, "probabilities"):
        return model.probabilities(df, name)
    if isinstance(model, LinearSVCModel) or isinstance(model, LogisticRegressionModel) and model.numClasses == 2:
        x = vector_to_array(model.getFeaturesCol())
        weights = F.array(*[F.lit(float(w)) for w in model.coefficients.toArray()])
        margin = F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(float(model.intercept)), lambda s, v: s + v)
        return df.withColumn(name, F.array(1 / (1 + F.exp(margin)), 1 / (1 + F.exp(-margin))))
    keep = df.columns
    return without_summary(model).transform(df).withColumn(name, vector_to_array("probability")).select(*keep, name)


def fits_at_once(rows: int) -> int:
    """Fits to run side by side: those of few rows mostly wait for their many short jobs, those of many rows need the memory."""
    return max(1, min(FITS_AT_ONCE, ROWS_AT_ONCE // max(1, rows)))


def fitted_all(spark: SparkSession, fits: Sequence[Callable[[], object]], at_once: int) -> list:
    """What the fits give, in their order, ``at_once`` of them at a time."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda fit: fit()), fits))


def _fit(member, rows: DataFrame) -> Callable[[], object]:
    own = member.copy() if isinstance(member, Estimator) else member  # threads do not share an estimator of MLlib
    return lambda: own.fit(rows)


def _average(names: Sequence[str]) -> Column:
    total = F.col(names[0])
    for n in names[1:]:
        total = F.zip_with(total, F.col(n), lambda a, b: a + b)
    return F.transform(total, lambda x: x / len(names))


def _with_class(df: DataFrame) -> DataFrame:
    best = F.array_position("probability", F.array_max("probability")) - 1
    return df.withColumn("prediction", best.cast("double"))


@dataclass
class SoftVote:
    """Mean of the class probabilities of several models after shared preparation."""

    prepare: PipelineModel
    models: list = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, prepare: Estimator, members: Sequence[Estimator]) -> SoftVote:
        ready = prepare.fit(df)
        shaped = dealt(ready.transform(df)).persist()
        models = [m.fit(shaped) for m in members]
        shaped.unpersist()
        return cls(ready, models)

    def transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        out = self.prepare.transform(df)
        names = [f"_p{i}" for i in range(len(self.models))]
        for name, m in zip(names, self.models):
            out = class_probabilities(m, out, name)
        return _with_class(out.withColumn("probability", _average(names))).select(*keep, "probability", "prediction")

    def save(self, path: str) -> None:
        save_parts(path, {"kind": "vote", "members": len(self.models)}, self.prepare, self.models)


@dataclass
class Stack:
    """Logistic regression over out-of-fold probabilities of the members."""

    prepare: PipelineModel
    models: list
    meta: LogisticRegressionModel

    @staticmethod
    def _meta_row(df: DataFrame, names: Sequence[str]) -> DataFrame:
        second = [F.element_at(n, 2) for n in names]
        return df.withColumn("_meta", array_to_vector(F.array(*second)))

    @classmethod
    def fit(
        cls, df: DataFrame, prepare: Estimator, members: Sequence[Estimator], label: str, key: str, folds: int = 3
    ) -> Stack:
        ready = prepare.fit(df)
        shaped = dealt(hash_folds(ready.transform(df), key, folds)).persist()
        names = [f"_p{i}" for i in range(len(members))]
        trains = [*(shaped.filter(F.col("fold") != fold) for fold in range(folds)), shaped]
        fits = [_fit(m, train) for m in members for train in trains]
        found = fitted_all(df.sparkSession, fits, fits_at_once(shaped.count()))
        by_train = [found[i :: len(trains)] for i in range(len(trains))]
        parts = None
        for fold in range(folds):
            out = shaped.filter(F.col("fold") == fold)
            for name, m in zip(names, by_train[fold]):
                out = class_probabilities(m, out, name)
            out = out.select(label, *names)
            parts = out if parts is None else parts.unionByName(out)
        scores = cut(cls._meta_row(parts, names).select(label, "_meta"))  # else every step of the fit scores again
        meta = logistic(label, "_meta", reg=0.0).fit(scores)
        models = by_train[folds]
        shaped.unpersist()
        return cls(ready, models, meta)

    def transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        out = self.prepare.transform(df)
        names = [f"_p{i}" for i in range(len(self.models))]
        for name, m in zip(names, self.models):
            out = class_probabilities(m, out, name)
        scored = class_probabilities(self.meta, self._meta_row(out, names), "probability")
        return _with_class(scored).select(*keep, "probability", "prediction")

    def save(self, path: str) -> None:
        save_parts(path, {"kind": "stack", "members": len(self.models)}, self.prepare, [*self.models, self.meta])


def save_parts(path: str, about: dict, prepare: PipelineModel, models: Sequence) -> None:
    """Writes the parts as MLlib folders and a one-row description."""
    prepare.write().overwrite().save(f"{path}/prepare")
    kinds = [type(m).__name__ if type(m) in OWN_MODELS else "" for m in models]
    for i, (m, kind) in enumerate(zip(models, kinds)):
        if kind:
            m.save(f"{path}/part-{i}")
        else:
            PipelineModel(stages=[m]).write().overwrite().save(f"{path}/part-{i}")
    SparkSession.active().createDataFrame([(json.dumps(about | {"kinds": kinds}),)], "about string").write.mode("overwrite").json(f"{path}/about")


def load_ensemble(path: str):
    """Reads a saved vote or stack."""
    about = json.loads(SparkSession.active().read.json(f"{path}/about").first()["about"])
    prepare = PipelineModel.load(f"{path}/prepare")
    own = {m.__name__: m for m in OWN_MODELS}
    models = [own[kind].load(f"{path}/part-{i}") if kind else PipelineModel.load(f"{path}/part-{i}").stages[0] for i, kind in enumerate(about["kinds"])]
    if about["kind"] == "vote":
        return SoftVote(prepare, models)
    return Stack(prepare, models[:-1], models[-1])


def importances(vote: SoftVote, names: Sequence[str]) -> list[tuple[str, float]]:
    """Mean feature importance over the tree models, highest first."""
    trees = [m for m in vote.models if hasattr(m, "featureImportances")]
    arrays = [m.featureImportances.toArray() for m in trees]
    mean = sum(np.pad(a, (0, max(0, len(names) - len(a)))) for a in arrays) / len(arrays)
    return sorted(((n, float(v)) for n, v in zip(names, mean)), key=lambda x: (-x[1], x[0]))
