"""The penalised perceptron against finite differences and a plain run of its rule."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from surveyloom.operators import perceptron as P
from surveyloom.session import fresh_path


def rows_of(spark, n, n_features=3, seed=1):
    """Two classes that a line separates with a gap."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, n_features))
    y = (x[:, 0] > 0).astype(int)
    x[:, 0] += np.where(y == 1, 1.0, -1.0)
    df = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y)], "x array<double>, label int")
    return df.select(array_to_vector("x").alias("features"), "label"), x, y


def test_gradient_equals_finite_differences():
    draw, layers = np.random.default_rng(3), [4, 5, 3, 3]
    flat, x, y = P.start(layers, 7), draw.normal(size=(11, 4)), draw.integers(0, 3, 11)
    assert len(flat) == 4 * 5 + 5 + 5 * 3 + 3 + 3 * 3 + 3
    _, grad = P.loss_and_gradient(flat, layers, x, y, 0.7)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (P.loss_and_gradient(flat + s, layers, x, y, 0.7)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-6


def test_penalty_spares_intercepts():
    layers, x, y = [2, 2], np.zeros((4, 2)), np.array([0, 1, 0, 1])
    flat = np.array([1.0, -2.0, 3.0, 4.0, 0.0, 0.0])
    loss, grad = P.loss_and_gradient(flat, layers, x, y, 0.5)
    assert np.isclose(loss, np.log(2) + 0.5 / 8 * 30)
    assert np.allclose(grad, [0.125, -0.25, 0.375, 0.5, 0, 0])


@pytest.mark.parametrize("per_part", [10_000, 100])
def test_stops_early_on_separable_rows_and_reruns_agree(spark, per_part):
    df, x, y = rows_of(spark, 400)
    fit = lambda d: P.PenalizedPerceptron(hidden=(4,), rate=2e-2, maxIter=60, patience=4, rowsPerPart=per_part).fit(d)
    model = fit(df)
    assert model.getOrDefault("epochs") < 60
    scored = model.transform(df)
    assert scored.where(F.col("label") == F.col("prediction")).count() >= 0.98 * 400
    again = fit(df.repartition(5))
    assert np.allclose(model.getOrDefault("weights"), again.getOrDefault("weights"), atol=1e-12)


def test_one_epoch_of_one_part_is_plain_adam(spark):
    df, x, y = rows_of(spark, 60)
    dealt = df.select(vector_to_array("features").alias("x"), F.col("label").alias("y"), F.lit(False).alias("held"), F.lit(0).alias("part"))
    layers, spec = [3, 4, 2], {"penalty": 0.1, "rate": 1e-2, "batch": 7, "seed": 5}
    flat = P.start(layers, 1)
    state = (flat, np.zeros_like(flat), np.zeros_like(flat), 0)
    got, share = P._epoch(dealt.coalesce(1), state, layers, spec, 2)
    order = np.random.default_rng([5, 2, 0]).permutation(60)
    want = P.adam(state, layers, x, y, 0.1, 1e-2, 7, order)
    assert share is None and got[3] == want[3] == 9
    assert all(np.allclose(a, b, atol=1e-15) for a, b in zip(got[:3], want[:3]))


def test_parts_are_averaged_by_their_rows(spark):
    df, x, y = rows_of(spark, 50)
    numbered = df.coalesce(1).withColumn("i", F.monotonically_increasing_id())
    dealt = numbered.select(
        vector_to_array("features").alias("x"), F.col("label").alias("y"), (F.col("i") % 10 == 0).alias("held"),
        F.when(F.col("i") < 30, 0).otherwise(1).alias("part"),
    )
    layers, spec = [3, 2], {"penalty": 0.0, "rate": 1e-2, "batch": 8, "seed": 0}
    flat = P.start(layers, 1)
    state = (flat, np.zeros_like(flat), np.zeros_like(flat), 0)
    got, share = P._epoch(dealt, state, layers, spec, 0)
    held, at = np.arange(50) % 10 == 0, np.arange(50)
    want, rows = np.zeros_like(flat), 0
    for part, own in ((0, at < 30), (1, at >= 30)):
        tx, ty = x[own & ~held], y[own & ~held]
        want += len(ty) * P.adam(state, layers, tx, ty, 0.0, 1e-2, 8, np.random.default_rng([0, 0, part]).permutation(len(ty)))[0]
        rows += len(ty)
    assert np.allclose(got[0], want / rows, atol=1e-15)
    assert share == (P.probabilities(flat, layers, x[held])[0].argmax(axis=1) == y[held]).mean()


def test_saved_model_and_rows_without_a_class(spark):
    df, x, y = rows_of(spark, 80)
    unknown = df.limit(5).withColumn("label", F.lit(None).cast("int"))
    model = P.PenalizedPerceptron(hidden=(3,), maxIter=2).fit(df.union(unknown))
    path = fresh_path(spark, "perceptron-model")
    model.write().save(path)
    again = P.PenalizedPerceptronModel.load(path)
    both = [[(r["prediction"], r["probability"]) for r in m.transform(df).collect()] for m in (model, again)]
    assert both[0] == both[1] and all(abs(sum(p) - 1) < 1e-12 for _, p in both[0])
    assert again.transform(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        P.PenalizedPerceptron().fit(unknown)
