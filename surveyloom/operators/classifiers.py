"""Classifier stages with the penalties and layouts of the survey models."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.neighbours import Neighbours
from surveyloom.operators.perceptron import PenalizedPerceptron
from surveyloom.schema import FOREST_PARAMS, KNN_PARAMS, MLP_PARAMS, PENALIZED_MLP_PARAMS

# Spark grows trees to at most this depth; it stands for "no limit".
DEEPEST = 30
# Numbers of the feature table that one task sums up per iteration, 16 MB of doubles.
VALUES_PER_TASK = 1 << 21


def width(df: DataFrame, features: str) -> int:
    """Length of the feature vectors; 0 for an empty table that does not tell."""
    known = df.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if known:
        return known
    first = df.select(features).first()
    return first[0].size if first else 0


class PenalizedLogistic(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Multinomial logistic regression with penalty 1/(C*N), which depends on the rows fitted.

    Mean log-loss plus half the penalty times the squared weights, intercepts
    free. The features are already scaled, so Spark's own scaling, which would
    change the penalty, stays off.

    An iteration sums over all rows, in whatever parts they come. Hundreds of
    iterations over small parts would be spent on starting tasks, so parts are put
    together, without a shuffle, until a task has ``VALUES_PER_TASK`` numbers.
    """

    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    labelCol = Param(Params._dummy(), "labelCol", "class", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "tolerance", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, C=0.5, labelCol="label", featuresCol="features", maxIter=200, tol=1e-9):
        super().__init__()
        self._setDefault(C=0.5, labelCol="label", featuresCol="features", maxIter=200, tol=1e-9)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        get = self.getOrDefault
        n = df.filter(F.col(get(self.labelCol)).isNotNull()).count()
        tasks = math.ceil(n * width(df, get(self.featuresCol)) / VALUES_PER_TASK)
        return LogisticRegression(
            family="multinomial",
            labelCol=get(self.labelCol),
            featuresCol=get(self.featuresCol),
            regParam=1.0 / (get(self.C) * max(n, 1)),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=get(self.maxIter),
            tol=get(self.tol),
        ).fit(df.coalesce(max(1, tasks)))


class Perceptron(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Spark's multilayer perceptron with layer sizes taken from the data.

    It has sigmoid hidden layers and no weight penalty or early stopping;
    ``PenalizedPerceptron`` has both.
    """

    hidden = Param(Params._dummy(), "hidden", "hidden layer sizes", TypeConverters.toListInt)
    labelCol = Param(Params._dummy(), "labelCol", "class", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, hidden=(64, 32), labelCol="label", featuresCol="features", maxIter=200, seed=42):
        super().__init__()
        self._setDefault(hidden=[64, 32], labelCol="label", featuresCol="features", maxIter=200, seed=42)
        kw = dict(self._input_kwargs)
        if "hidden" in kw:
            kw["hidden"] = list(kw["hidden"])
        self._set(**kw)

    def _fit(self, df: DataFrame):
        get = self.getOrDefault
        features, label = get(self.featuresCol), get(self.labelCol)
        top = df.agg(F.max(label)).first()[0]
        return MultilayerPerceptronClassifier(
            layers=[width(df, features), *get(self.hidden), int(top) + 1],
            labelCol=label,
            featuresCol=features,
            maxIter=get(self.maxIter),
            seed=get(self.seed),
            blockSize=128,
        ).fit(df)


def logistic(label: str = "label", C: float = 0.5) -> PenalizedLogistic:
    return PenalizedLogistic(labelCol=label, C=C)


def forest(
    label: str = "label",
    trees: int = FOREST_PARAMS["trees"],
    depth: int | None = FOREST_PARAMS["depth"],
    min_leaf: int = FOREST_PARAMS["min_leaf"],
    features: str = FOREST_PARAMS["features"],
    bootstrap: bool = FOREST_PARAMS["bootstrap"],
    seed: int = FOREST_PARAMS["seed"],
) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=label,
        numTrees=trees,
        maxDepth=DEEPEST if depth is None else depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy=str(features),
        bootstrap=bootstrap,
        seed=seed,
        cacheNodeIds=True,
        maxMemoryInMB=512,
    )


def perceptron(
    label: str = "label",
    hidden=MLP_PARAMS["hidden"],
    max_iter: int = MLP_PARAMS["max_iter"],
    seed: int = MLP_PARAMS["seed"],
) -> Perceptron:
    return Perceptron(labelCol=label, hidden=list(hidden), maxIter=max_iter, seed=seed)


def penalized_perceptron(
    label: str = "label",
    hidden=PENALIZED_MLP_PARAMS["hidden"],
    penalty: float = PENALIZED_MLP_PARAMS["penalty"],
    rate: float = PENALIZED_MLP_PARAMS["rate"],
    batch: int = PENALIZED_MLP_PARAMS["batch"],
    max_iter: int = PENALIZED_MLP_PARAMS["max_iter"],
    patience: int = PENALIZED_MLP_PARAMS["patience"],
    seed: int = PENALIZED_MLP_PARAMS["seed"],
    rows_per_part: int = 16_384,
) -> PenalizedPerceptron:
    return PenalizedPerceptron(
        labelCol=label, hidden=list(hidden), penalty=penalty, rate=rate, batch=batch, maxIter=max_iter,
        patience=patience, rowsPerPart=rows_per_part, seed=seed,
    )


def neighbours(
    label: str = "label",
    id_col: str = "row_id",
    k: int = KNN_PARAMS["k"],
    p: int = KNN_PARAMS["p"],
    weights: str = KNN_PARAMS["weights"],
) -> Neighbours:
    return Neighbours(labelCol=label, idCol=id_col, k=k, p=p, weights=weights)
