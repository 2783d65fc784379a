"""Splits, naive Bayes, indicators, scaling and neighbours against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from surveyloom.functions.text import tokenize
from surveyloom.operators import classifiers as K
from surveyloom.operators import cleaning as C
from surveyloom.operators import multihot as M
from surveyloom.operators import naive_bayes as N
from surveyloom.operators import neighbours as G
from surveyloom.operators import sketches
from surveyloom.operators import splits as P
from surveyloom.operators import standardize as Z
from surveyloom.operators.neighbours import nearest, vote
from surveyloom.session import materialise


def labelled(spark, n=403, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaabbc"), f"u{0 if rng.random() < 0.35 else rng.randint(1, 60)}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, y string, who string")


def test_kfold_sizes_and_independence_of_layout(spark):
    df = labelled(spark)
    rows = P.stratified_kfold(df, "y", "id", 5, 42).collect()
    assert len(rows) == 403
    # the allocation of dealing class-sorted labels out in turn, classes by first appearance
    first = list(dict.fromkeys(r["y"] for r in df.orderBy("id").collect()))
    order = sorted((first.index(r["y"]) for r in rows))
    want = {(c, f): 0 for c in range(len(first)) for f in range(5)}
    for place, c in enumerate(order):
        want[(c, place % 5)] += 1
    got = Counter((first.index(r["y"]), r["fold"]) for r in rows)
    assert {k: v for k, v in want.items() if v} == dict(got)
    again = P.stratified_kfold(df.repartition(13), "y", "id", 5, 42, digits=1).collect()
    assert {r["id"]: r["fold"] for r in again} == {r["id"]: r["fold"] for r in rows}
    other = P.stratified_kfold(df, "y", "id", 5, 43).collect()
    assert {r["id"]: r["fold"] for r in other} != {r["id"]: r["fold"] for r in rows}


def test_kfold_null_class(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(30)], "id long, y string")
    sizes = Counter((r["y"], r["fold"]) for r in P.stratified_kfold(df, "y", "id", 3).collect())
    assert set(sizes.values()) <= {3, 4, 6, 7} and sum(sizes.values()) == 30


def test_groups_stay_together_with_a_hot_group(spark, monkeypatch):
    df = labelled(spark)
    folded = P.stratified_group_kfold(df, "y", "who", 4, 42)
    rows = folded.collect()
    assert len(rows) == 403 and all(r["fold"] is not None for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["who"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in by.values())
    # u0 alone is hot; without the hot path the result is the same
    monkeypatch.setattr(P, "HOT_SHARE", 2.0)
    plain = {r["id"]: r["fold"] for r in P.stratified_group_kfold(df, "y", "who", 4, 42).collect()}
    assert plain == {r["id"]: r["fold"] for r in rows}
    groups = Counter(next(iter(f)) for f in by.values())
    assert max(groups.values()) - min(groups.values()) <= 1


def test_holdout_sizes(spark):
    df = labelled(spark)
    n = Counter(r["y"] for r in df.collect())
    got = Counter(r["y"] for r in P.holdout(df, "y", "id", 0.8).filter("is_train").collect())
    assert got == {c: round(m * 0.8) for c, m in n.items()}
    assert P.holdout(df, None, "id", 0.85, stratify=False).filter("is_train").count() == round(403 * 0.85)
    tiny = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, y string")
    got = Counter((r["y"], r["is_train"]) for r in P.holdout(tiny, "y", "id", 0.99).collect())
    assert got == {("a", True): 1, ("a", False): 1, ("b", True): 1}


TEXTS = [
    (0, "calm green water"), (0, "calm pond pond"), (0, None), (1, "night sky night"), (1, "dreamy sky"),
    (1, "calm sky"), (2, "melting clocks"), (2, "clock time calm"), (2, "123"), (2, "desert time"),
]


def text_frame(spark):
    rows = [(i, y, t) for i, (y, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, label int, food_text string").repartition(4)


def brute_force(tokens, labels, k, alpha):
    sets = [set(t) - {"missing"} for t in tokens]
    df = Counter(t for s in sets for t in s)
    vocab = [t for t, _ in sorted(df.items(), key=lambda kv: (-kv[1], kv[0]))[:k]]
    x = np.array([[t in s for t in vocab] for s in sets], dtype=float)
    y = np.array(labels)
    classes = sorted(set(labels))
    n = np.array([(y == c).sum() for c in classes], dtype=float)
    p = np.array([(x[y == c].sum(0) + alpha) / (m + 2 * alpha) for c, m in zip(classes, n)])
    s = x @ np.log(p).T + (1 - x) @ np.log(1 - p).T + np.log(n / n.sum())
    s[x.sum(1) == 0] = np.log(n / n.sum())
    e = np.exp(s - s.max(1, keepdims=True))
    return vocab, p, e / e.sum(1, keepdims=True), x.sum(1)


@pytest.mark.parametrize("k,alpha", [(3, 0.5), (100, 1.0)])
def test_naive_bayes_against_brute_force(spark, k, alpha):
    df = text_frame(spark)
    rows = df.select("id", "label", tokenize(F.col("food_text")).alias("t")).orderBy("id").collect()
    vocab, p, probs, hits = brute_force([r["t"] for r in rows], [r["label"] for r in rows], k, alpha)
    (m,) = N.fit_text_models(df, "label", {"food_text": k}, alpha)
    assert m.vocab == vocab and np.allclose(m.prob, p, atol=1e-15)

    def check(scored):
        got = scored.orderBy("id").collect()
        assert np.allclose([[r[f"food_nb_p{i}"] for i in range(3)] for r in got], probs, atol=1e-12)
        assert [r["food_nb_hit_count"] for r in got] == list(hits)
        assert [r["food_nb_zero_hit"] for r in got] == [int(h == 0) for h in hits]
        assert [r["food_nb_pred"] for r in got] == list(np.argmax(probs, axis=1))

    check(N.score_text(df, m))
    back = N.from_tables(*N.to_tables(spark, [m]))[0]
    check(N.score_text(df, back))


def test_vocabularies_of_any_size_are_scored_by_saved_stages(spark, tmp_path):
    df = spark.range(600).selectExpr("id", "id % 2 AS label", "concat('w', translate(string(id * 7 % 3001), '0123456789', 'abcdefghij'), ' w', translate(string(id * 11 % 3001), '0123456789', 'abcdefghij')) AS food_text")
    stage = N.TextScores(labelCol="label", sizes={"food_text": 5000}).fit(df)
    assert len(stage.models[0].vocab) > 900
    path = str(tmp_path / "stage")
    stage.write().save(path)
    out = N.TextScoresModel.load(path).transform(df).orderBy("id").collect()
    m = stage.models[0]
    place = {t: j for j, t in enumerate(m.vocab)}
    for r in out[:50]:
        hits = [place[t] for t in set(r["food_text"].split()) if t in place]
        score = [b + sum(m.deltas[j][k] for j in hits) for k, b in enumerate(m.base)]
        assert r["food_nb_hit_count"] == len(hits)
        assert np.isclose(r["food_nb_p1"], 1 / (1 + np.exp(score[0] - score[1])))


def test_naive_bayes_errors_and_fixed_vocabulary(spark):
    df = text_frame(spark)
    with pytest.raises(ValueError):
        N.fit_text_models(df, "label", {"food_text": 0})
    with pytest.raises(ValueError):
        N.fit_text_models(df.filter("id = 8"), "label", {"food_text": 5})
    (m,) = N.fit_text_models(df, "label", {"food_text": 2}, vocab={"food_text": ["sky", "absent"]})
    assert m.vocab == ["sky", "absent"] and m.doc_freq == [3, 0]
    classes, tokens = N.to_tables(spark, [m])
    with pytest.raises(ValueError):
        N.from_tables(classes, tokens.filter("idx = 0 OR k = 1"))
    one = N.predict_texts(spark, m, ["sky"]).first()
    assert abs(sum(one[f"food_nb_p{i}"] for i in range(3)) - 1) < 1e-12


@pytest.mark.parametrize("parts", [64, 1])
def test_models_by_fold_equal_direct_fits(spark, monkeypatch, parts):
    monkeypatch.setattr(N, "PARTS", parts)
    df = text_frame(spark).withColumn("fold", (F.col("id") % 2).cast("int")).withColumn("b_text", F.lit("sky time x"))
    sizes = {"food_text": 4, "b_text": 2}
    # counted for larger vocabularies than asked for
    by_fold = N.count_by_fold(df, "label", "fold", 2, {"food_text": 9, "b_text": 2}).models(sizes, 0.5)
    for f in range(2):
        direct = N.fit_text_models(df.filter(F.col("fold") != f), "label", sizes, 0.5)
        for a, b in zip(by_fold[f], direct):
            assert (a.vocab, a.class_count, a.classes, a.doc_freq) == (b.vocab, b.class_count, b.classes, b.doc_freq)
            assert np.allclose(a.prob, b.prob)


def test_multi_hot(spark):
    df = spark.createDataFrame([("A b,C",), ("C, C,Missing",), (None,), ("zz",)], "room string")
    model = M.MultiHot(inputCols=["room"], prefixes=["Which room would you put it in?"]).fit(df.filter("room <> 'zz'"))
    assert model.options == {"room": ["A b", "C"]}
    out = model.transform(df)
    assert out.columns == ["room", "which_room_would_you_put__a_b", "which_room_would_you_put__c"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 1), (0, 1), (0, 0), (0, 0)]
    folds = df.withColumn("fold", F.when(F.col("room") == "zz", 1).otherwise(0))
    assert M.categories_by_fold(folds, ["room"], "fold", 2) == {0: {"room": ["zz"]}, 1: {"room": ["A b", "C"]}}


def test_multi_hot_with_equal_slugs(spark):
    df = spark.createDataFrame([("A-B",), ("A B,日本",), ("a_b,雨",)], "room string")
    model = M.MultiHot(inputCols=["room"]).fit(df)
    names = ["room__a_b", "room__a_b_2", "room__a_b_3", "room__", "room___2"]
    assert model.output_columns() == names
    got = model.transform(df).select(*names).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0, 0, 0), (1, 0, 0, 1, 0), (0, 0, 1, 0, 1)]
    with pytest.raises(ValueError):
        M.categories(df, ["room"], most=4)
    with pytest.raises(ValueError):
        M.categories_by_fold(df.withColumn("fold", F.lit(0)), ["room"], "fold", 1, most=4)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5, "x", None), (2.0, 5, "y", None), (6.0, 5, "z", None)], "a double, b int, c string, d double")
    assert Z.numeric_feature_columns(df, ["d"]) == ["a", "b"]
    means, devs = Z.moments(df, ["a", "b", "d"])
    assert np.allclose(means, [3, 5, 0]) and np.allclose(devs, [np.std([1, 2, 6]), 1, 1])
    model = Z.ScaledFeatures(exclude=["d"]).fit(df)
    x = np.array([r["features"].toArray() for r in model.transform(df).collect()])
    assert np.allclose(x[:, 0], (np.array([1, 2, 6]) - 3) / np.std([1, 2, 6])) and np.allclose(x[:, 1], 0)
    # absent columns count as zero
    x = model.transform(df.select("a")).first()["features"].toArray()
    assert np.isclose(x[1], -5)
    assert Z.align_columns(df, ["b", "new"], ["c"]).columns == ["c", "b", "new"]
    assert Z.random_columns(list("abc"), None, 1) == list("abc")
    some = Z.random_columns(list("abcdef"), 3, 1)
    assert len(set(some)) == 3 and some == Z.random_columns(list("abcdef"), 3, 1)
    with pytest.raises(ValueError):
        Z.random_columns(list("abc"), 0, 1)


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("layout", [{}, {"pivots": 6, "block_rows": 25, "chunk_rows": 20}])
def test_neighbours_against_brute_force(spark, p, layout):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(90, 3)), np.repeat([[0.5, 0.5, 0.5]], 60, axis=0), rng.normal(5, 1, size=(30, 3))])
    y = rng.integers(0, 3, len(x))
    q = np.vstack([rng.normal(size=(20, 3)), [[0.5, 0.5, 0.5], [9, 9, 9]]])
    train = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "tid long, y int, x array<double>")
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "qid long, x array<double>")
    near = nearest(train.repartition(5), queries.repartition(3), 7, p, **layout)
    got = {}
    for r in near.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["tid"], r["dist"]))
    votes = {r["qid"]: r["pred"] for r in vote(near).collect()}
    plain = {r["qid"]: r["pred"] for r in vote(near, "uniform").collect()}
    for i, v in enumerate(q):
        d = np.abs(x - v).sum(1) if p == 1 else np.sqrt(((x - v) ** 2).sum(1))
        order = np.lexsort((np.arange(len(x)), np.round(d, 12)))[:7]
        assert [t for t, _ in got[i]] == list(order)
        assert np.allclose([e for _, e in got[i]], d[order])
        w = np.zeros(3)
        zero = d[order] < 1e-12
        for j, t in enumerate(order):
            if zero.any():
                w[y[t]] += zero[j]
            else:
                w[y[t]] += 1 / d[t]
        assert votes[i] == int(np.argmax(w))
        assert plain[i] == int(np.argmax(np.bincount(y[order], minlength=3)))


@pytest.mark.parametrize("p", [1, 2])
def test_neighbours_travel_once_per_group_and_chunk(spark, monkeypatch, p):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(700, 20)), rng.normal(size=(1, 20)) + rng.normal(0, 1e-9, size=(100, 20)), 1e6 * rng.normal(size=(5, 20))])
    q = np.vstack([rng.normal(size=(120, 20)), x[700:720], x[:10]])
    rows = [(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(-1, 0, None), (-2, 0, [float("nan")] * 20), (-3, 0, [None] + [0.0] * 19), (-4, 0, [float("inf")] * 20)]
    train = spark.createDataFrame([*rows, *odd], "tid long, y int, x array<double>")
    asked = [(i, [float(v) for v in r]) for i, r in enumerate(q)]
    queries = spark.createDataFrame([*asked, (900, None), (901, [float("nan")] * 20)], "qid long, x array<double>")
    sent, inner = [spark.sparkContext.accumulator(0) for _ in range(2)], G._nearest_in_group
    left, right = sent

    def counted(*args):
        run = inner(*args)

        def both(a, b):
            left.add(a.num_rows)
            right.add(b.num_rows)
            return run(a, b)

        return both

    monkeypatch.setattr(G, "_nearest_in_group", counted)
    monkeypatch.setattr(G, "LEAST_TASK_ROWS", 1)
    # tiles of 8 by 4: blocks and chunks of that size would travel 38 and 101 times
    near = nearest(train, queries, 9, p, pivots=12, block_rows=8, chunk_rows=4, task_rows=300).collect()
    assert left.value <= 2 * 810 * (G.CHUNKS + 1) and right.value <= 150 * (2 * G.GROUPS + 2)
    got = {}
    for r in sorted(near, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["dist"], r["tid"]))
    assert set(got) == set(range(len(q)))
    for i, v in enumerate(q):
        d = G._distances(v[None], x, p)[0]
        assert got[i] == sorted(zip(d.tolist(), range(len(x))))[:9]


def test_balanced_groups_stay_within_their_bound(spark):
    sizes = [500] + [40] * 10 + [1] * 900
    rng = random.Random(3)
    rows = [(i, g, rng.choice("ab")) for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    df = spark.createDataFrame([*rows, (9_000, None, "a"), (9_001, None, None)], "i int, g int, y string")
    out = P.balanced_group_kfold(df, "y", "g", 5, 42).collect()
    assert len(out) == len(rows) + 2
    of, per, by = {}, Counter(), Counter()
    for r in out:
        assert of.setdefault(r.g, r.fold) == r.fold
        per[r.fold] += 1
        by[(r.fold, r.y)] += 1
    assert sorted(per) == list(range(5)) and max(per.values()) <= max(500, 1.1 * len(out) / 5)
    assert all(abs(by[(f, "a")] - by[(f, "b")]) <= 60 for f in range(5))
    assert P.balanced_group_kfold(df.where("false"), "y", "g").collect() == []


def test_votes_of_many_settings_equal_votes_of_one(spark):
    near = [(q, t, "xyz"[(q * t) % 3], float((q + 3 * t) % 7), r + 1) for q in range(20) for r, t in enumerate(sorted(range(12), key=lambda t: ((q + 3 * t) % 7, t)))]
    df = spark.createDataFrame(near, "qid int, tid int, y string, dist double, rank int")
    got = {(r.qid, r.k, r.weights): r.pred for r in G.vote_grid(df, [1, 4, 12]).collect()}
    for k in (1, 4, 12):
        for w in ("uniform", "distance"):
            want = {(r.qid, k, w): r.pred for r in G.vote(df.where(f"rank <= {k}"), w).collect()}
            assert {x: p for x, p in got.items() if x[1:] == (k, w)} == want


def test_fills_fall_back_to_the_training_rows(spark):
    train = spark.createDataFrame([(1.0, 10.0, None), (3.0, 20.0, None)], "a double, b double, c double")
    model = C.Fills(inputCols=["a", "b", "c"]).fit(train)
    rows = spark.createDataFrame([(None, 5.0, None), (None, None, None)], "a double, b double, c double")
    assert [tuple(r) for r in model.transform(rows).collect()] == [(2.0, 5.0, 0.0), (2.0, 5.0, 0.0)]
    alone = C.Fills(inputCols=["a", "b"], batch=False).fit(train)
    assert [tuple(r) for r in alone.transform(rows).collect()] == [(2.0, 5.0, None), (2.0, 15.0, None)]


def test_merged_sketches_stay_within_their_rank_error(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 10).alias("part"), F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")).alias("a"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 1000).alias("b"), F.lit(None).cast("double").alias("none"),
    )
    parts = materialise(sketches.sketched(df, ["a", "b", "none"], "part"))
    assert parts.count() == 20 and {r.name for r in parts.select("name").distinct().collect()} == {"a", "b"}
    asked = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = sketches.merged_quantiles(parts, {"a": asked, "b": asked, "none": [0.5]})
    assert got["none"] == [None]
    for c in ("a", "b"):
        n = df.select(c).dropna().count()
        for q, v in zip(asked, got[c]):
            below, upto = df.agg(F.count_if(F.col(c) < v), F.count_if(F.col(c) <= v)).first()
            slack = 3 * sketches.rank_error() * n
            assert below - slack <= q * n <= upto + slack
    assert parts.agg(F.max(F.octet_length("sketch"))).first()[0] < 8 * 3 * sketches.K
    assert sketches.merged_medians(parts.where("false"), ["a"]) == {"a": None}


def test_logistic_iterates_over_few_large_tasks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, float(c), [rng.gauss(c, 1.0), rng.gauss(-c, 2.0)]) for i in range(600) for c in [rng.randint(0, 2)]]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>").select("id", "label", array_to_vector("x").alias("features"))
    seen, fit = [], K.LogisticRegression.fit

    def counted(self, rows):
        seen.append((rows.rdd.getNumPartitions(), rows.count()))
        return fit(self, rows)

    monkeypatch.setattr(K.LogisticRegression, "fit", counted)
    whole = K.logistic(C=0.5).fit(df.repartition(64, "id"))
    # 1,200 numbers, 100 a task
    monkeypatch.setattr(K, "VALUES_PER_TASK", 100, raising=False)
    parts = K.logistic(C=0.5).fit(df.repartition(64, "id"))
    assert seen == [(1, 600), (12, 600)]
    assert np.allclose(whole.coefficientMatrix.toArray(), parts.coefficientMatrix.toArray(), atol=1e-5)
    assert np.allclose(whole.interceptVector.toArray(), parts.interceptVector.toArray(), atol=1e-5)
