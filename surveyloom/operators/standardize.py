"""Column means and population deviations, and the scaled feature vector."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: deviations below this count as constant columns.
TINY = 1e-12


def numeric_feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric and boolean columns that are not excluded."""
    drop = set(exclude)
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in drop]


def align_columns(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted columns as doubles, 0 where absent; other columns go unless kept."""
    have = set(df.columns)
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        *[(F.col(f"`{c}`").cast("double") if c in have else F.lit(0.0)).alias(c) for c in wanted],
    )


def random_columns(names: Sequence[str], size: int | None, seed: int) -> list[str]:
    """``size`` of the names without replacement; all of them for None or a large size."""
    names = list(names)
    if size is None or size >= len(names):
        return names
    if size <= 0:
        raise ValueError("size must be positive or None")
    return random.Random(seed).sample(names, size)


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation of every column in one pass.

    Constant and empty columns get deviation 1, empty ones mean 0.
    """
    row = df.agg(
        *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(cols))]
    devs = [row[f"s{i}"] for i in range(len(cols))]
    return means, [1.0 if s is None or s < TINY else s for s in devs]


def standardize(df: DataFrame, cols: Sequence[str], means: Sequence[float], devs: Sequence[float]) -> DataFrame:
    """(x - mean) / deviation in place; absent columns count as 0."""
    have = set(df.columns)

    def scaled(c, m, s):
        x = F.col(f"`{c}`").cast("double") if c in have else F.lit(0.0)
        return (x - F.lit(m)) / F.lit(s)

    return df.withColumns({c: scaled(c, m, s) for c, m, s in zip(cols, means, devs)})


class ScaledFeaturesModel(Model, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Feature columns to one vector: aligned, scaled, absent columns 0."""

    means = Param(Params._dummy(), "means", "column means", TypeConverters.toListFloat)
    devs = Param(Params._dummy(), "devs", "column deviations", TypeConverters.toListFloat)

    def __init__(self, cols=None, out="features", means=None, devs=None):
        super().__init__()
        if cols is not None:
            self._set(inputCols=list(cols), outputCol=out, means=list(means), devs=list(devs))

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, out = self.getInputCols(), self.getOutputCol()
        have = set(df.columns)
        names = [f"_x{i}" for i in range(len(cols))]
        scaled = {
            n: ((F.col(f"`{c}`").cast("double") if c in have else F.lit(0.0)) - F.lit(m)) / F.lit(s)
            for n, c, m, s in zip(names, cols, self.getOrDefault(self.means), self.getOrDefault(self.devs))
        }
        wide = df.withColumns(scaled)
        return VectorAssembler(inputCols=names, outputCol=out).transform(wide).drop(*names)


class ScaledFeatures(Estimator, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Picks the numeric columns, optionally a random subset, and learns their scale."""

    exclude = Param(Params._dummy(), "exclude", "columns that are no features", TypeConverters.toListString)
    scale = Param(Params._dummy(), "scale", "whether to scale", TypeConverters.toBoolean)
    subset = Param(Params._dummy(), "subset", "number of features, 0 for all", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the subset", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, exclude=None, outputCol="features", scale=True, subset=0, seed=42):
        super().__init__()
        self._setDefault(exclude=[], outputCol="features", scale=True, subset=0, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ScaledFeaturesModel:
        cols = numeric_feature_columns(df, self.getOrDefault(self.exclude))
        size = self.getOrDefault(self.subset)
        cols = random_columns(cols, size or None, self.getOrDefault(self.seed))
        means, devs = [0.0] * len(cols), [1.0] * len(cols)
        if self.getOrDefault(self.scale):
            means, devs = moments(df, cols)
        return ScaledFeaturesModel(cols, self.getOutputCol(), means, devs)
