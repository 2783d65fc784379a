"""From a cleaned table to a fitted pipeline: text scores, indicators, scaling, classifier."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.operators import classifiers as K
from surveyloom.operators.multihot import MultiHot, MultiHotModel
from surveyloom.operators.naive_bayes import TextScores, TextScoresModel, tokenized
from surveyloom.operators.standardize import ScaledFeatures, numeric_feature_columns
from surveyloom.plans.clean import clean, clean_alternative
from surveyloom.schema import (
    ALTERNATIVE,
    CANONICAL_TO_RAW,
    FINAL,
    KNN_PARAMS,
    SURVEY,
    TrainSpec,
)
from surveyloom.session import materialise
from surveyloom.sources.tables import read_cleaned, read_csv

KINDS = ("logistic", "knn", "forest", "mlp", "mlp_penalized")


@dataclass(frozen=True)
class Layout:
    """Which columns of a table are texts, multi-selects, label, id; numbers are found by type."""

    texts: tuple = SURVEY.open_texts
    multi_selects: tuple = SURVEY.multi_selects
    label: str = SURVEY.label_col
    row_id: str = "row_id"
    # never features, besides label, id and texts
    exclude: tuple = (SURVEY.id_col, SURVEY.class_col)
    sep: str = ","

    @property
    def plain_texts(self) -> list[str]:
        """Texts that are not read as options too."""
        return [c for c in self.texts if c not in self.multi_selects]

    @property
    def not_features(self) -> list[str]:
        return [self.label, self.row_id, *self.exclude, *self.texts, *self.multi_selects]


@dataclass(frozen=True)
class Recipe:
    """A classifier kind with all its parameters."""

    kind: str = "logistic"
    train: TrainSpec = FINAL
    params: dict = field(default_factory=dict)
    multihot: bool = True
    standardize: bool | None = None
    # rows of a fit that one task works on in each iteration
    rows_per_partition: int = 10_000

    @property
    def include_pred(self) -> bool:
        return self.kind not in ("mlp", "mlp_penalized")

    @property
    def scale(self) -> bool:
        return self.kind != "forest" if self.standardize is None else self.standardize

    @property
    def scores_key(self) -> tuple:
        """Recipes with equal keys share their text scores and indicators."""
        return (tuple(self.train.vocab_sizes.items()), self.train.nb_alpha, self.include_pred, self.multihot)

    def with_(self, **changes) -> "Recipe":
        """Change parameters by name: vocabulary sizes by column, nb_alpha, C, or classifier ones."""
        train, params = self.train, dict(self.params)
        for name, value in changes.items():
            if name in train.vocab_sizes:
                train = replace(train, vocab_sizes={**train.vocab_sizes, name: value})
            elif name in ("nb_alpha", "C"):
                train = replace(train, **{name: value})
            else:
                params[name] = value
        return replace(self, train=train, params=params)


# Tuned presets: the final model and the three alternatives.
PRESETS = {
    "logistic": Recipe("logistic", FINAL),
    "knn": Recipe("knn", ALTERNATIVE),
    "forest": Recipe("forest", ALTERNATIVE),
    "mlp": Recipe("mlp", ALTERNATIVE),
    "mlp_penalized": Recipe("mlp_penalized", ALTERNATIVE),
}


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A unique id that grows in file order."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


def _indicator_prefixes(layout: Layout) -> list[str]:
    return [CANONICAL_TO_RAW.get(c, c) for c in layout.multi_selects]


def fit_scores(df: DataFrame, recipe: Recipe, layout: Layout) -> PipelineModel:
    """The fitted indicator and text-score stages."""
    stages = []
    if recipe.multihot and layout.multi_selects:
        stages.append(
            MultiHot(
                inputCols=list(layout.multi_selects), sep=layout.sep, prefixes=_indicator_prefixes(layout)
            ).fit(df)
        )
    if recipe.train.vocab_sizes:
        stages.append(
            TextScores(
                labelCol=layout.label,
                sizes=recipe.train.vocab_sizes,
                alpha=recipe.train.nb_alpha,
                includePred=recipe.include_pred,
            ).fit(df)
        )
    return PipelineModel(stages=stages)


def scores_from_parts(models, options, recipe: Recipe, layout: Layout) -> PipelineModel:
    """The same stages from counts that were gathered elsewhere."""
    stages = []
    if recipe.multihot and layout.multi_selects:
        stages.append(
            MultiHotModel(list(layout.multi_selects), options, layout.sep, _indicator_prefixes(layout))
        )
    stages.append(TextScoresModel(models, recipe.include_pred))
    return PipelineModel(stages=stages)


def classifier(recipe: Recipe, layout: Layout):
    p = {k: v for k, v in recipe.params.items() if k not in ("subset_size", "seed") or recipe.kind in ("forest", "mlp", "mlp_penalized")}
    if recipe.kind == "logistic":
        return K.logistic(layout.label, C=recipe.train.C)
    if recipe.kind == "knn":
        return K.neighbours(layout.label, layout.row_id, **p)
    if recipe.kind == "forest":
        return K.forest(layout.label, **p)
    if recipe.kind == "mlp":
        return K.perceptron(layout.label, **p)
    if recipe.kind == "mlp_penalized":
        return K.penalized_perceptron(layout.label, **p)
    raise ValueError(f"unknown classifier {recipe.kind}")


def arranged(df: DataFrame, row_id: str, rows_per_partition: int) -> DataFrame:
    """Rows in partitions by hash of their id, sorted by it, however they came.

    Fits that draw rows by partition (a forest's bags) then depend on the rows
    and the argument alone, not on how the table was cut.
    """
    n = max(1, math.ceil(df.count() / rows_per_partition))
    return df.repartition(n, row_id).sortWithinPartitions(row_id)


def fit_classifier(scored: DataFrame, recipe: Recipe, layout: Layout, exclude: Sequence[str] = (), fold: int = 0):
    """Feature vector and classifier on a table that has its scores."""
    scored = arranged(scored, layout.row_id, recipe.rows_per_partition)
    subset, seed = 0, 42
    if recipe.kind == "knn":
        subset = recipe.params.get("subset_size", KNN_PARAMS["subset_size"]) or 0
        seed = recipe.params.get("seed", KNN_PARAMS["seed"])
    features = ScaledFeatures(
        exclude=[*layout.not_features, *exclude], scale=recipe.scale, subset=subset, seed=seed + fold
    ).fit(scored)
    model = classifier(recipe, layout).fit(features.transform(scored))
    return PipelineModel(stages=[features, model])


def train(df: DataFrame, recipe: Recipe = PRESETS["logistic"], layout: Layout = Layout()) -> PipelineModel:
    """Fit everything on a cleaned table.

    Texts are tokenized once, for counting and for scoring. The scored rows
    are written too, so scaling and the classifier's iterations read numbers.
    """
    df = with_row_id(df, layout.row_id).filter(F.col(layout.label).isNotNull())
    df = tokenized(df, layout.plain_texts)
    scores = fit_scores(df, recipe, layout)
    scored = materialise(scores.transform(df).drop(*layout.texts, *layout.multi_selects), "scored")
    fitted = fit_classifier(scored, recipe, layout)
    return PipelineModel(stages=[*scores.stages, *fitted.stages])


def feature_table(df: DataFrame, scores: PipelineModel, layout: Layout) -> DataFrame:
    """Base numbers, indicators and text scores side by side: one projection, no join."""
    wide = scores.transform(df)
    keep = [c for c in (layout.row_id, layout.label) if c in wide.columns]
    return wide.select(*keep, *[F.col(f"`{c}`") for c in numeric_feature_columns(wide, layout.not_features)])


def train_preset(
    spark: SparkSession, path: str, kind: str = "logistic", is_cleaned: bool = True
) -> PipelineModel:
    """Fit a preset on a stored table, cleaning it first if it is raw."""
    if is_cleaned:
        df = read_cleaned(spark, path)
    else:
        raw = read_csv(spark, path)
        df = clean(raw).df if kind == "logistic" else clean_alternative(raw).df
    return train(df, PRESETS[kind])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
