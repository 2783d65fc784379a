"""Accuracy under cross-validation, hold-out splits and parameter grids."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.operators.multihot import categories_by_fold
from surveyloom.operators.naive_bayes import count_by_fold, fit_repeated, score_texts, tokenized, training_sides
from surveyloom.operators.neighbours import nearest, vote_grid
from surveyloom.operators.splits import holdout, stratified_group_kfold, stratified_kfold
from surveyloom.plans.train import (
    Layout,
    Recipe,
    fit_classifier,
    fit_scores,
    scores_from_parts,
    with_row_id,
)
from surveyloom.session import materialise


def accuracy(pred: str = "prediction", label: str = "label") -> Column:
    return F.avg((F.col(pred) == F.col(label)).cast("double"))


def describe(recipe: Recipe) -> str:
    """Parameters as text: readable and a stable last sort key."""
    return json.dumps({**asdict(recipe.train), **recipe.params}, sort_keys=True, default=str)


def summarise(scores: DataFrame, by: Sequence[str], value: str = "acc", order: str = "fold") -> DataFrame:
    """Mean, population deviation and list of the fold accuracies per setting."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return scores.groupBy(*by).agg(
        F.transform(ordered, lambda s: s[value]).alias("fold_scores"),
        F.avg(value).alias("mean_val_acc"),
        F.stddev_pop(value).alias("std_val_acc"),
    )


def rank_results(results: DataFrame) -> DataFrame:
    """Best mean first, then the steadier one, then by parameters."""
    return results.orderBy(F.desc("mean_val_acc"), F.asc("std_val_acc"), F.asc("params"))


def identified(df: DataFrame, layout: Layout) -> DataFrame:
    """Labelled rows with a unique id; an id made here is written down, so it never changes."""
    known = df.filter(F.col(layout.label).isNotNull())
    return known if layout.row_id in df.columns else materialise(with_row_id(known, layout.row_id), "rows")


def assign_folds(
    df: DataFrame, layout: Layout, n_splits: int = 5, seed=42, group_col: str | None = None
) -> DataFrame:
    """Fold column; with a group column its rows stay together."""
    df = identified(df, layout)
    if group_col and group_col in df.columns:
        return stratified_group_kfold(df, layout.label, group_col, n_splits, seed)
    return stratified_kfold(df, layout.label, layout.row_id, n_splits, seed)


def _at_once(df: DataFrame, work, tasks, parallelism: int) -> list:
    """Submit independent Spark work from several driver threads."""
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), tasks, chunksize=1)


def cross_validate(
    df: DataFrame,
    recipes: Sequence[Recipe],
    layout: Layout = Layout(),
    n_splits: int = 5,
    seed=42,
    group_col: str | None = None,
    parallelism: int = 8,
) -> DataFrame:
    """One result row per recipe; everything fitted is fitted without the validation fold.

    Texts are tokenized once. One scan of the tokens gives the counts of all
    folds and settings, and one per fold and vocabulary setting the scores;
    recipes that differ only in the classifier share the scored table. ``parallelism`` fits are submitted at a time.
    """
    folded = tokenized(assign_folds(df, layout, n_splits, seed, group_col), layout.plain_texts)
    scores: dict[int, list[float]] = {i: [0.0] * n_splits for i in range(len(recipes))}
    shared: dict[tuple, list[int]] = {}
    for i, r in enumerate(recipes):
        shared.setdefault(r.scores_key, []).append(i)
    widest: dict[str, int] = {}
    for r in recipes:
        for col, k in r.train.vocab_sizes.items():
            widest[col] = max(k, widest.get(col, 0))
    counts = count_by_fold(folded, layout.label, "fold", n_splits, widest)
    options = {}
    if layout.multi_selects and any(r.multihot for r in recipes):
        options = categories_by_fold(folded, layout.multi_selects, "fold", n_splits, layout.sep)
    for members in shared.values():
        lead = recipes[members[0]]
        models = counts.models(lead.train.vocab_sizes, lead.train.nb_alpha)

        def score(f: int) -> DataFrame:
            stages = scores_from_parts(models[f], options.get(f), lead, layout)
            wide = stages.transform(folded).drop(*layout.texts, *layout.multi_selects)
            return materialise(wide, "scored")

        def fit(task: tuple[int, int]) -> None:
            f, i = task
            inside, outside = scored[f].filter(F.col("fold") != f), scored[f].filter(F.col("fold") == f)
            fitted = fit_classifier(inside, recipes[i], layout, exclude=["fold"], fold=f)
            hits = fitted.transform(outside).agg(accuracy("prediction", layout.label).alias("a"))
            scores[i][f] = hits.first()["a"]

        scored = _at_once(df, score, range(n_splits), parallelism)
        _at_once(df, fit, list(product(range(n_splits), members)), parallelism)
    rows = [(i, r.kind, describe(r), f, scores[i][f]) for i, r in enumerate(recipes) for f in range(n_splits)]
    per_fold = df.sparkSession.createDataFrame(rows, "i int, kind string, params string, fold int, acc double")
    return summarise(per_fold, ["i", "kind", "params"]).orderBy("i").drop("i")


def expand_grid(base: Recipe, grid: Mapping[str, Iterable]) -> list[Recipe]:
    """Every combination of the grid values."""
    names = list(grid)
    return [base.with_(**dict(zip(names, values))) for values in product(*grid.values())]


# Default search grids of the alternatives.
GRIDS = {
    "knn": {"k": [5, 7, 9, 11, 13], "weights": ["uniform", "distance"], "p": [1, 2]},
    "forest": {"trees": [150, 175, 200], "depth": [12, 14, 16], "min_leaf": [1, 2]},
    "mlp": {"hidden": [(64,), (64, 32), (128, 64)], "max_iter": [500]},
}


def grid_search(
    df: DataFrame,
    base: Recipe,
    grid: Mapping[str, Iterable] | None = None,
    layout: Layout = Layout(),
    n_splits: int = 3,
    seed=42,
    group_col: str | None = None,
) -> tuple[dict, DataFrame]:
    """Best parameters and the ranked result table."""
    recipes = expand_grid(base, GRIDS[base.kind] if grid is None else grid)
    ranked = rank_results(cross_validate(df, recipes, layout, n_splits, seed, group_col))
    best = ranked.first()
    return {
        "best_params": json.loads(best["params"]),
        "best_mean_val_acc": best["mean_val_acc"],
        "best_std_val_acc": best["std_val_acc"],
    }, ranked


def grid_search_knn(
    df: DataFrame,
    ks: Sequence[int] = tuple(GRIDS["knn"]["k"]),
    weights: Sequence[str] = tuple(GRIDS["knn"]["weights"]),
    powers: Sequence[int] = tuple(GRIDS["knn"]["p"]),
    id_col: str = "row_id",
    label: str = "label",
    vector: str = "x",
    n_splits: int = 3,
    seed=42,
    **search,
) -> tuple[dict, DataFrame]:
    """Best setting of a neighbour model and the ranked settings (k, weights, p, fold_scores, mean, deviation, place).

    Each fold is searched once per power with the largest k; the votes of every k
    and weighting come from that one list. Rows without a label or vector are left out.
    """
    known = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    folded = stratified_kfold(known.select(id_col, label), label, id_col, n_splits, seed).select(id_col, "fold")
    rows = materialise(known.select(id_col, label, vector).join(folded, id_col), "knn-folds")

    def accuracies(task: tuple[int, int]) -> DataFrame:
        fold, p = task
        train = rows.where(F.col("fold") != fold).select(F.col(id_col).alias("tid"), F.col(label).alias("y"), F.col(vector).alias("x"))
        asked = rows.where(F.col("fold") == fold).select(F.col(id_col).alias("qid"), F.col(vector).alias("x"))
        found = materialise(nearest(train, asked, max(ks), p, **search), "knn-found")
        truth = rows.select(F.col(id_col).alias("qid"), F.col(label).alias("truth"))
        scored = vote_grid(found, ks, weights).join(truth, "qid")
        return materialise(
            scored.groupBy("k", "weights").agg(accuracy("pred", "truth").alias("acc")).select(
                "k", "weights", F.lit(p).alias("p"), F.lit(fold).alias("fold"), "acc"
            ), "knn-accuracy",
        )

    per_fold = _at_once(df, accuracies, list(product(range(n_splits), powers)), n_splits * len(powers))
    table = per_fold[0]
    for t in per_fold[1:]:
        table = table.unionByName(t)
    results = summarise(table, ["k", "weights", "p"])
    # one partition, but of settings only; equal results go by their setting
    order = Window.orderBy(F.desc(F.round("mean_val_acc", 9)), F.asc(F.round("std_val_acc", 9)), "k", "weights", "p")
    ranked = materialise(results.withColumn("place", F.row_number().over(order)), "knn-ranked").orderBy("place")
    best = ranked.first()
    return {c: best[c] for c in ("k", "weights", "p", "mean_val_acc", "std_val_acc")}, ranked


def evaluate_holdout(
    df: DataFrame,
    recipe: Recipe,
    layout: Layout = Layout(),
    train_size: float = 0.8,
    seed=42,
    stratify: bool = True,
) -> dict:
    """Training and validation accuracy of one split."""
    df = tokenized(identified(df, layout), layout.plain_texts)
    # the split is ids alone, drawn apart from the texts
    ids = holdout(df.select(layout.row_id, layout.label), layout.label, layout.row_id, train_size, seed, stratify)
    split = df.join(materialise(ids.select(layout.row_id, "is_train"), "split"), layout.row_id)
    scores = fit_scores(split.filter("is_train"), recipe, layout)
    scored = materialise(scores.transform(split).drop(*layout.texts, *layout.multi_selects), "scored")
    fitted = fit_classifier(scored.filter("is_train"), recipe, layout, exclude=["is_train"])
    rows = (
        fitted.transform(scored)
        .groupBy("is_train")
        .agg(F.count("*").alias("n"), accuracy("prediction", layout.label).alias("acc"))
        .collect()
    )
    by = {r["is_train"]: r for r in rows}
    return {
        "kind": recipe.kind,
        "params": describe(recipe),
        "train_size": train_size,
        "seed": seed,
        "stratify": stratify,
        "train_rows": by[True]["n"] if True in by else 0,
        "val_rows": by[False]["n"] if False in by else 0,
        "train_acc": by[True]["acc"] if True in by else None,
        "val_acc": by[False]["acc"] if False in by else None,
    }


def repeated_holdout(df: DataFrame, recipe: Recipe, seeds: Iterable, layout: Layout = Layout(), **kwargs) -> DataFrame:
    """One row per seed; texts are tokenized once for all of them."""
    df = tokenized(identified(df, layout), layout.plain_texts)
    rows = _at_once(df, lambda s: evaluate_holdout(df, recipe, layout, seed=s, **kwargs), list(seeds), 8)
    cols = ["kind", "params", "seed", "train_rows", "val_rows", "train_acc", "val_acc"]
    return df.sparkSession.createDataFrame(
        [tuple(r[c] for c in cols) for r in rows],
        "kind string, params string, seed int, train_rows long, val_rows long, train_acc double, val_acc double",
    )


def repeated_nb(
    df: DataFrame, column: str, label: str, id_col: str, seeds: int = 50, k: int = 40, alpha: float = 0.5, train_size: float = 0.8
) -> DataFrame:
    """Accuracy of a naive Bayes text model on many random splits: (seed, train_rows, val_rows, train_acc, val_acc).

    All splits share one tokenized table, one counting scan and one scoring scan.
    Rows without a label are left out.
    """
    known = df.where(F.col(label).isNotNull()).select(id_col, label, column)
    known = tokenized(known.withColumn("_sides", training_sides(id_col, seeds, train_size)), [column])
    model = fit_repeated(known, label, column, "_sides", seeds, k, alpha)
    truth = (F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col(label)) - 1).cast("int")
    scored = model.predicted(known, column, "_preds").select("_sides", "_preds", truth.alias("_truth"))

    def one(s: int, side: int) -> Column:
        right = (F.get("_preds", F.lit(s)) == F.col("_truth")).cast("double")
        here = F.get("_sides", F.lit(s)) == side
        return F.struct(F.count_if(here).alias("n"), F.avg(F.when(here, right)).alias("acc"))

    per = scored.agg(F.array(*[F.struct(F.lit(s).alias("seed"), one(s, 1).alias("t"), one(s, 0).alias("v")) for s in range(seeds)]).alias("r"))
    return per.select(F.inline("r")).select(
        "seed", F.col("t.n").alias("train_rows"), F.col("v.n").alias("val_rows"),
        F.col("t.acc").alias("train_acc"), F.col("v.acc").alias("val_acc"),
    )


def text_model_accuracy(df: DataFrame, scores: PipelineModel, label: str = "label") -> DataFrame:
    """Accuracy of each text model alone: (column, accuracy)."""
    models = scores.stages[-1].models
    one = score_texts(df, models).agg(*[accuracy(f"{m.prefix}_pred", label).alias(f"a{i}") for i, m in enumerate(models)])
    pairs = F.array(
        *[F.struct(F.lit(m.column).alias("column"), F.col(f"a{i}").alias("accuracy")) for i, m in enumerate(models)]
    )
    return one.select(F.inline(pairs))
