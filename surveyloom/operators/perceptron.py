"""A multilayer perceptron with a weight penalty that stops early on held-out rows."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.session import materialise

# One row of these in HELD is held out for the stopping rule.
HELD = 10
# Copies of one row that are made in one go.
RUN = 4096
# Adam's decay rates and the guard of its divisor.
FIRST, SECOND, EPSILON = 0.9, 0.999, 1e-8
# An epoch improves if its share of right held-out rows grows by more than this.
GAIN = 1e-4

# executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shapes(layers: Sequence[int]) -> list[tuple[int, int]]:
    return list(zip(layers[:-1], layers[1:]))


def parts_of(flat: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, intercepts) of each layer, as views of the flat vector."""
    out, at = [], 0
    for a, b in shapes(layers):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def start(layers: Sequence[int], seed: int) -> np.ndarray:
    """Uniform weights whose range goes by the sizes of both layers; intercepts likewise."""
    draw, out = np.random.default_rng(seed), []
    for a, b in shapes(layers):
        most = math.sqrt(6.0 / (a + b))
        out.append(draw.uniform(-most, most, a * b + b))
    return np.concatenate(out)


def probabilities(flat: np.ndarray, layers: Sequence[int], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Class probabilities of the rows, and what each layer received."""
    took = [x]
    stages = parts_of(flat, layers)
    for i, (w, b) in enumerate(stages):
        z = took[-1] @ w + b
        if i + 1 < len(stages):
            took.append(np.tanh(z))
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), took


def loss_and_gradient(flat: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, penalty: float):
    """Mean log loss plus ``penalty`` / 2 times the squared weights per row of the batch; intercepts are free."""
    n, at = len(x), np.arange(len(x))
    p, took = probabilities(flat, layers, x)
    stages, grad = parts_of(flat, layers), np.empty_like(flat)
    loss = -np.log(np.maximum(p[at, y], 1e-300)).mean() + penalty / (2 * n) * sum((w * w).sum() for w, _ in stages)
    delta = p.copy()
    delta[at, y] -= 1
    for i in range(len(stages) - 1, -1, -1):
        gw, gb = parts_of(grad, layers)[i]
        gw[:] = (took[i].T @ delta + penalty * stages[i][0]) / n
        gb[:] = delta.sum(axis=0) / n
        if i:
            delta = (delta @ stages[i][0].T) * (1 - took[i] ** 2)
    return loss, grad


def adam(state: tuple, layers, x, y, penalty: float, rate: float, batch: int, order: np.ndarray) -> tuple:
    """(weights, first moments, second moments, steps) after the rows in this order, ``batch`` of them a step."""
    flat, m, v, steps = state[0].copy(), state[1].copy(), state[2].copy(), state[3]
    for i in range(0, len(order), batch):
        rows = order[i : i + batch]
        _, g = loss_and_gradient(flat, layers, x[rows], y[rows], penalty)
        steps += 1
        m = FIRST * m + (1 - FIRST) * g
        v = SECOND * v + (1 - SECOND) * g * g
        step = rate * math.sqrt(1 - SECOND**steps) / (1 - FIRST**steps)
        flat -= step * m / (np.sqrt(v) + EPSILON)
    return flat, m, v, steps


def _epoch(rows: DataFrame, state: tuple, layers: Sequence[int], spec: dict, turn: int):
    """The averaged state after an epoch, and the share of right held-out rows before it.

    Each part of the rows starts from the same state and makes its own steps; the
    states are averaged by the parts' rows. Sums are decimals, so they do not depend
    on the order in which tasks end, nor on how parts are dealt to tasks.
    """
    given = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = given.value

        def learned(part: int, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
            right = int((probabilities(now[0], layers, x[held])[0].argmax(axis=1) == y[held]).sum()) if held.any() else 0
            tx, ty = x[~held], y[~held]
            order = np.random.default_rng([spec["seed"], turn, part]).permutation(len(ty))
            flat, m, v, steps = adam(now, layers, tx, ty, spec["penalty"], spec["rate"], spec["batch"], order)
            n = len(ty)
            # behind the weights: rows, steps, right and held-out rows
            extra = np.array([n, steps * n, right, held.sum()], dtype=np.float64)
            return pa.record_batch(
                [
                    pa.array(np.arange(len(flat) + len(extra))),
                    pa.array(np.concatenate((flat * n, extra))),
                    pa.array(np.concatenate((m * n, np.zeros(len(extra))))),
                    pa.array(np.concatenate((v * n, np.zeros(len(extra))))),
                ],
                names=["at", "w", "m", "v"],
            )

        part, got = None, []
        for batch in batches:
            ids = batch.column("part").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            y, held = batch.column("y").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids)) if len(ids) else []
            begin = 0
            for end in ends:
                if part is not None and ids[begin] != part:
                    yield learned(part, *[np.concatenate(c) for c in zip(*got)])
                    got = []
                part = int(ids[begin])
                got.append((x[begin:end], y[begin:end], held[begin:end]))
                begin = end
        if got:
            yield learned(part, *[np.concatenate(c) for c in zip(*got)])

    sums = rows.mapInArrow(run, "at long, w double, m double, v double").groupBy("at")
    exact = [F.sum(F.col(c).cast("decimal(38,18)")).cast("double").alias(c) for c in ("w", "m", "v")]
    got = sums.agg(*exact).toPandas().sort_values("at")
    given.unpersist()
    w, m, v = (got[c].to_numpy() for c in ("w", "m", "v"))
    n, steps, right, held = w[-4:]
    return (w[:-4] / n, m[:-4] / n, v[:-4] / n, int(round(steps / n))), right / held if held else None


class _PerceptronParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of numbers", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "probabilities of the classes", TypeConverters.toString)
    layers = Param(Params._dummy(), "layers", "sizes of all layers", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "weights and intercepts of all layers", TypeConverters.toListFloat)
    epochs = Param(Params._dummy(), "epochs", "epochs that were run", TypeConverters.toInt)

    def _outputs(self):
        self._setDefault(featuresCol="features", predictionCol="prediction", probabilityCol="probability")


class PenalizedPerceptronModel(Model, _PerceptronParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the probabilities of the classes and the most probable one, the smaller on a tie."""

    def __init__(self):
        super().__init__()
        self._outputs()

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        layers, flat = list(get(self.layers)), np.array(get(self.weights))

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(probabilities(flat, layers, np.stack(x.to_numpy()).astype(np.float64))[0]))

        p = get(self.probabilityCol)
        out = df.withColumn(p, score(vector_to_array(get(self.featuresCol))))
        out = out.withColumn(get(self.predictionCol), (F.array_position(p, F.array_max(p)) - 1).cast("double"))
        return out.withColumn(p, array_to_vector(p))


class PenalizedPerceptron(Estimator, _PerceptronParams, DefaultParamsReadable, DefaultParamsWritable):
    """Tanh layers and a softmax, fitted by Adam on mini-batches with a penalty of the weights.

    Rows are dealt into parts of about ``rowsPerPart`` by hash. In each epoch all parts
    start from the same weights, go through their rows in mini-batches, and their
    weights and moments are averaged; one part is plain mini-batch Adam. To the driver
    come sums of the size of the network, one job an epoch.

    One row in ten, by hash of its values (equal rows are on one side), is held out. The
    fit stops when the share of right ones has not grown for ``patience`` epochs, or
    after ``maxIter``, and returns the weights of the best epoch. With no held-out row
    all epochs are run and the last weights returned. Rows without a class are left
    out; labels are 0, 1, ...; no labelled row is an error.
    """

    hidden = Param(Params._dummy(), "hidden", "hidden layer sizes", TypeConverters.toListInt)
    labelCol = Param(Params._dummy(), "labelCol", "class", TypeConverters.toString)
    penalty = Param(Params._dummy(), "penalty", "penalty of squared weights", TypeConverters.toFloat)
    rate = Param(Params._dummy(), "rate", "first step size", TypeConverters.toFloat)
    batch = Param(Params._dummy(), "batch", "rows a step", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "most epochs", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "epochs without a gain", TypeConverters.toInt)
    rowsPerPart = Param(Params._dummy(), "rowsPerPart", "rows that one task takes together", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, hidden=(64, 32), labelCol="label", featuresCol="features", penalty=5e-3, rate=1e-3, batch=16,
        maxIter=500, patience=20, rowsPerPart=16_384, seed=42,
    ):
        super().__init__()
        self._outputs()
        self._setDefault(
            hidden=[64, 32], labelCol="label", penalty=5e-3, rate=1e-3, batch=16, maxIter=500, patience=20,
            rowsPerPart=16_384, seed=42,
        )
        kw = dict(self._input_kwargs)
        if "hidden" in kw:
            kw["hidden"] = list(kw["hidden"])
        self._set(**kw)

    def _fit(self, df: DataFrame) -> PenalizedPerceptronModel:
        get = self.getOrDefault
        spec = {n: get(getattr(self, n)) for n in ("penalty", "rate", "batch", "seed")}
        rows = df.where(F.col(get(self.labelCol)).isNotNull()).select(
            vector_to_array(get(self.featuresCol)).alias("x"), F.col(get(self.labelCol)).cast("int").alias("y")
        )
        # equal rows are one with a count until they are dealt
        rows = materialise(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "perceptron-rows")
        n, top, width = rows.agg(F.sum("n"), F.max("y"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no row has a class")
        layers = [width, *get(self.hidden), top + 1]
        mark = F.xxhash64("x", "y", F.lit(spec["seed"]))
        n_parts = math.ceil(n / get(self.rowsPerPart))
        dealt = rows.withColumn("mark", mark).withColumn("held", F.pmod("mark", F.lit(HELD)) == 0)
        # copies of a row go to different parts; RUN of them at most are told off at once
        dealt = dealt.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
        last = F.least(F.lit(RUN - 1).cast("long"), F.col("n") - 1 - F.col("run") * RUN)
        dealt = dealt.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        part = F.pmod(F.xxhash64("mark", "run", "copy"), F.lit(n_parts)).cast("int")
        dealt = dealt.select("x", "y", "held", "mark", part.alias("part"))
        dealt = dealt.repartition(n_parts, "part").sortWithinPartitions("part", "mark")
        dealt = materialise(dealt.drop("mark"), "perceptron-parts")
        flat = start(layers, spec["seed"])
        state, best, since, turn = (flat, np.zeros_like(flat), np.zeros_like(flat), 0), None, 0, 0
        while True:
            after, share = _epoch(dealt, state, layers, spec, turn)
            # the share is that of the weights before this epoch
            if share is not None and (best is None or share > best[0] + GAIN):
                best, since = (share, state[0], turn), 0
            else:
                since += 1
            if turn == get(self.maxIter) or (best is not None and since >= get(self.patience)):
                break
            state, turn = after, turn + 1
        chosen = best[1] if best else state[0]
        model = PenalizedPerceptronModel()._set(layers=layers, weights=[float(w) for w in chosen], epochs=turn)
        return self._copyValues(model)
