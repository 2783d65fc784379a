"""Training, evaluation and scoring of the whole survey."""

import math

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from surveyloom.operators.neighbours import NeighboursModel
from surveyloom.plans import evaluate as E
from surveyloom.plans import train as T
from surveyloom.plans.clean import clean_final
from surveyloom.plans.score import evaluate_file, file_report, predict_file, predict_records, score_raw, summarise_report
from surveyloom.schema import CANONICAL_TO_RAW, LABEL_TITLES, RAW_TO_CANONICAL
from surveyloom.session import fresh_path, materialise
from surveyloom.streaming.score import run_available, run_batches, score_survey_stream

TITLES = set(LABEL_TITLES.values())
SMALL = {"food_text": 8, "feeling_text": 10, "soundtrack_text": 8}


@pytest.fixture(scope="module")
def cleaned(raw_survey):
    return materialise(T.with_row_id(clean_final(raw_survey).df))


@pytest.fixture(scope="module")
def recipe():
    return T.PRESETS["logistic"].with_(**SMALL)


@pytest.fixture(scope="module")
def model(cleaned, recipe):
    return T.train(cleaned, recipe)


def test_feature_table_has_forty_columns(cleaned, recipe):
    layout = T.Layout()
    wide = T.feature_table(cleaned, T.fit_scores(cleaned, recipe, layout), layout)
    names = [c for c in wide.columns if c not in ("row_id", "label")]
    indicators = [c for c in names if "__" in c]
    scores = [c for c in names if "_nb_" in c]
    assert len(scores) == 18 and len(names) - len(scores) - len(indicators) == 8
    assert names[:8] == [c for c in cleaned.columns if c in names[:8]]
    mlp = T.PRESETS["mlp"].with_(**SMALL)
    other = T.feature_table(cleaned, T.fit_scores(cleaned, mlp, layout), layout)
    assert len([c for c in other.columns if "_nb_" in c]) == 15


def test_logistic_is_at_the_penalised_optimum(cleaned, model, recipe):
    scored = model.transform(cleaned).select("features", "label").collect()
    x = np.array([r["features"].toArray() for r in scored])
    y = np.array([r["label"] for r in scored])
    lr = model.stages[-1]
    w, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    s = x @ w.T + b
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gap = p - np.eye(3)[y]
    n, lam = len(x), 1.0 / (recipe.train.C * len(x))
    assert np.abs(gap.T @ x / n + lam * w).max() < 1e-5
    assert np.abs(gap.mean(0)).max() < 1e-5


def test_model_survives_storage(spark, cleaned, model):
    path = fresh_path(spark, "model")
    T.save_model(model, path)
    again = T.load_model(path)
    p = vector_to_array("probability")
    a = model.transform(cleaned).select("row_id", p.alias("p")).orderBy("row_id").collect()
    b = again.transform(cleaned).select("row_id", p.alias("p")).orderBy("row_id").collect()
    assert np.allclose([r["p"] for r in a], [r["p"] for r in b])
    assert np.allclose([sum(r["p"]) for r in a], 1)


def write_raw(df, path):
    names = [CANONICAL_TO_RAW[c] for c in df.columns]
    df.toDF(*names).coalesce(1).write.option("header", True).option("escape", '"').csv(path)


def test_single_hostile_records_get_titles(spark, hostile, model):
    got = predict_records(spark, hostile, model).collect()
    assert sorted(r["row_id"] for r in got) == list(range(7))
    assert all(r["pred_name"] in TITLES for r in got)
    alone = [predict_records(spark, [r], model).first()["pred_name"] for r in hostile[-2:]]
    assert alone == [r["pred_name"] for r in sorted(got, key=lambda r: r["row_id"])][-2:]


def test_hostile_file_gets_one_title_per_row(spark, hostile, model, tmp_path):
    cols = list(RAW_TO_CANONICAL)
    rows = [tuple(None if r.get(c) is None else str(r[c]) for c in cols) for r in hostile]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_TO_CANONICAL.values()))
    write_raw(df, str(tmp_path / "bad"))
    got = predict_file(spark, str(tmp_path / "bad"), model).orderBy("row_id").collect()
    assert len(got) == 7 and all(r["pred_name"] in TITLES for r in got)
    result = evaluate_file(spark, str(tmp_path / "bad"), model)
    assert result["rows_raw"] == 7 and result["rows_without_label"] == 5


def test_file_with_few_columns(spark, model, tmp_path):
    df = spark.createDataFrame(
        [("sad and quiet", None), (None, "idk"), (None, None)], "feeling_text string, payment string"
    )
    write_raw(df, str(tmp_path / "few"))
    assert predict_file(spark, str(tmp_path / "few"), model).count() == 3


def test_stream_scores_equal_batch_scores(spark, raw_survey, model):
    base = fresh_path(spark, "incoming")
    rows = raw_survey.withColumn("row_id", F.monotonically_increasing_id())
    rows.repartition(3).write.parquet(base)
    fills = {"payment": 50.0, "intensity": 6.0}
    stream = spark.readStream.schema(rows.schema).parquet(base)
    out = run_available(score_survey_stream(stream, model, fills).select("row_id", "pred_name"), "scored")
    batch = score_raw(rows, model, fill="train", train_fills=fills)
    want = {r["row_id"]: r["pred_name"] for r in batch.collect()}
    assert {r["row_id"]: r["pred_name"] for r in out.collect()} == want and len(want) == 150


def test_damaged_file_keeps_every_line(spark, raw_survey, model, tmp_path):
    path = str(tmp_path / "torn")
    write_raw(raw_survey.limit(20).withColumn("painting", F.when(F.col("unique_id") == "2", "No such title").otherwise(F.col("painting"))), path)
    header = ",".join(f'"{c}"' for c in RAW_TO_CANONICAL)
    torn = ['77,"The Starry Night",5', "78," + "," * 30, "", "79"]
    (tmp_path / "torn" / "part-99.csv").write_text("\n".join([header, *torn]) + "\n")
    found = materialise(file_report(spark, path, model, columns=list(RAW_TO_CANONICAL), multi_line=False))
    rows = found.collect()
    bad = [r for r in rows if r.state == "damaged"]
    assert sorted(r.line for r in bad) == sorted(x for x in torn if x)  # a blank line is none
    assert all(r.pred is None and r.label is None for r in bad) and {r.unique_id for r in bad} == {"77", "78", "79"}
    assert len(rows) == 23 and len({r.row_id for r in rows}) == 23
    assert [r.unique_id for r in rows if r.state == "unknown"] == ["2"] * 3
    assert all(r.pred_name in TITLES and abs(sum(r.probability) - 1) < 1e-9 for r in rows if r.state != "damaged")
    done = summarise_report(found).first()
    right = [r.pred == r.label for r in rows if r.state == "scored"]
    assert (done.lines, done.damaged, done.unknown, done.scored) == (23, 3, 3, 17) and math.isclose(done.accuracy, np.mean(right))
    less = file_report(spark, path, model, columns=list(RAW_TO_CANONICAL), multi_line=False, drop_unknown=True)
    assert summarise_report(less).first()[:4] == (20, 3, 0, 17)
    assert summarise_report(found.where("false")).first() == (0, 0, 0, 0, None)


def test_stopped_stream_writes_no_row_twice(spark):
    source, base = fresh_path(spark, "numbers"), fresh_path(spark, "numbers-out")
    spark.range(100).repartition(5).write.parquet(source)
    runs, stopped = [], []

    def stop(number):
        runs.append(number)
        if number in (1, 3) and number not in stopped:
            stopped.append(number)
            raise InterruptedError("written, but not noted")

    def go():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        return run_batches(stream, "n", lambda b: b.withColumn("size", F.lit(b.count())), base, stop)

    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            go()
    out = go()
    assert runs == [0, 1, 1, 2, 3, 3, 4] and out.columns == ["id", "size"]
    assert sorted(r.id for r in out.collect()) == list(range(100))
    assert out.select(F.sum(1 / F.col("size"))).first()[0] == pytest.approx(5)
    assert go().count() == 100  # nothing new: nothing changes


def test_cross_validation_fits_without_the_fold(spark, cleaned, recipe):
    other = recipe.with_(C=0.05)
    results = E.cross_validate(cleaned, [recipe, other], n_splits=3).collect()
    assert [len(r["fold_scores"]) for r in results] == [3, 3]
    # the first fold by hand
    layout = T.Layout()
    folded = E.assign_folds(cleaned, layout, 3)
    inside, outside = folded.filter("fold <> 0"), folded.filter("fold = 0")
    fitted = T.train(inside.drop("fold"), recipe)
    acc = fitted.transform(outside).agg(E.accuracy().alias("a")).first()["a"]
    assert math.isclose(acc, results[0]["fold_scores"][0])
    assert math.isclose(results[0]["mean_val_acc"], np.mean(results[0]["fold_scores"]))
    assert math.isclose(results[0]["std_val_acc"], np.std(results[0]["fold_scores"]), abs_tol=1e-12)


def test_grid_search_ranks(spark, cleaned):
    base = T.PRESETS["knn"].with_(**SMALL)
    best, ranked = E.grid_search(cleaned, base, {"k": [3, 5], "weights": ["uniform", "distance"]}, n_splits=2, group_col="unique_id")
    rows = ranked.collect()
    keys = [(-r["mean_val_acc"], r["std_val_acc"], r["params"]) for r in rows]
    assert len(rows) == 4 and keys == sorted(keys)
    assert best["best_mean_val_acc"] == rows[0]["mean_val_acc"] and best["best_params"]["k"] in (3, 5)
    assert len(E.expand_grid(T.PRESETS["forest"], E.GRIDS["forest"])) == 18
    assert len(E.expand_grid(T.PRESETS["knn"], E.GRIDS["knn"])) == 20


@pytest.mark.parametrize(
    "kind,params",
    [
        ("forest", {"trees": 10}), ("mlp", {"hidden": (8,), "max_iter": 40}), ("knn", {"k": 5}),
        ("mlp_penalized", {"hidden": (8,), "max_iter": 30, "rate": 1e-2}),
    ],
)
def test_alternatives_learn(cleaned, kind, params):
    recipe = T.PRESETS[kind].with_(**SMALL, **params)
    result = E.evaluate_holdout(cleaned, recipe, train_size=0.75)
    assert result["train_rows"] + result["val_rows"] == cleaned.count()
    assert result["val_acc"] > 0.6


def test_holdout_and_text_accuracy(cleaned, recipe):
    rows = E.repeated_holdout(cleaned, recipe, [0, 1]).collect()
    assert [r["seed"] for r in rows] == [0, 1] and all(r["val_acc"] > 0.7 for r in rows)
    acc = E.text_model_accuracy(cleaned, T.fit_scores(cleaned, recipe, T.Layout())).collect()
    assert {r["column"] for r in acc} == set(SMALL) and all(0.5 < r["accuracy"] <= 1 for r in acc)


def test_fold_summary(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 1.0), ("b", 0, 0.2)], "p string, fold int, acc double")
    got = {r["p"]: r for r in E.summarise(df, ["p"]).collect()}
    assert got["a"]["fold_scores"] == [1.0, 0.5] and math.isclose(got["a"]["std_val_acc"], 0.25)


def test_forest_depends_on_the_rows_alone(spark, cleaned):
    rows = cleaned.withColumn("row_id", F.xxhash64(*cleaned.columns)).dropDuplicates(["row_id"])
    recipe = T.Recipe("forest", T.PRESETS["forest"].train, {"trees": 5}).with_(**SMALL)
    found = []
    for parts in (1, 9):
        df = rows.repartition(parts)
        found.append({r["row_id"]: r["prediction"] for r in T.train(df, recipe).transform(df).collect()})
    assert found[0] == found[1] and len(found[0]) > 100


def test_saved_neighbours_model_holds_its_rows(spark, cleaned):
    model = T.train(cleaned, T.PRESETS["knn"].with_(**SMALL))
    path = fresh_path(spark, "knn-model")
    T.save_model(model, path)
    again = T.load_model(path)
    assert isinstance(again.stages[-1], NeighboursModel)
    assert again.stages[-1].getOrDefault("table").startswith(path)
    a = {r["row_id"]: r["prediction"] for r in model.transform(cleaned).collect()}
    assert {r["row_id"]: r["prediction"] for r in again.transform(cleaned).collect()} == a


def test_train_preset_from_files(spark, raw_survey, tmp_path):
    write_raw(raw_survey, str(tmp_path / "raw"))
    fitted = T.train_preset(spark, str(tmp_path / "raw"), "logistic", is_cleaned=False)
    result = evaluate_file(spark, str(tmp_path / "raw"), fitted)
    assert result["rows_raw"] == 150 and result["accuracy"] > 0.8
