"""Bernoulli naive Bayes over the most frequent tokens of text columns."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.text import vocab_tokens
from surveyloom.session import materialise, spread

# Fixed value: probabilities stay this far from 0 and 1.
CLIP = 1e-12
# Parts of a group of tokens that are ranked apart before the group is.
PARTS = 64


@dataclass
class TextModel:
    """Fitted state of one text column; lists run over classes, then over the vocabulary."""

    column: str
    prefix: str
    classes: list
    class_count: list
    vocab: list
    prob: list
    doc_freq: list = field(default_factory=list)

    @property
    def log_prior(self) -> list[float]:
        total = sum(self.class_count)
        return [math.log(n / total) for n in self.class_count]

    @property
    def base(self) -> list[float]:
        """Score of a text without any vocabulary token, were it not for the zero-hit rule."""
        return [lp + sum(math.log(1.0 - p) for p in row) for lp, row in zip(self.log_prior, self.prob)]

    @property
    def deltas(self) -> list[list[float]]:
        """Per token, what its presence adds to each class."""
        return [
            [math.log(row[j]) - math.log(1.0 - row[j]) for row in self.prob] for j in range(len(self.vocab))
        ]


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class, NULL left out, ordered by class."""
    rows = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()
    return {r[label]: r["n"] for r in sorted(rows, key=lambda r: r[label])}


def tokenized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace texts by their vocabulary tokens and write the table once.

    Tokenizing costs far more than reading the tokens back, so whoever counts
    and scores the same rows does it first. Counting and scoring take a text
    column in either form; a table whose columns are tokens already is returned as it is.
    """
    columns = [c for c in columns if not isinstance(df.schema[c].dataType, T.ArrayType)]
    if not columns:
        return df
    return materialise(spread(df).withColumns({c: vocab_tokens(F.col(c)) for c in columns}), "tokens")


def tokens_of(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.col(column)
    return vocab_tokens(F.col(column))


def token_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Documents per (column, token) and ``by``, from one scan of all texts.

    Result: c (position of the column), token, the ``by`` columns, n. Partial sums
    leave one row per token, ``by`` and task to shuffle, however frequent a token is.
    """

    def tag(i: int, col: str) -> Column:
        return F.transform(
            tokens_of(df, col), lambda t: F.struct(F.lit(i).alias("c"), t.alias("token"))
        )

    if not all(isinstance(df.schema[c].dataType, T.ArrayType) for c in columns):
        df = spread(df.select(*columns, *by))
    if len(columns) == 1:
        hits = df.select(F.lit(0).alias("c"), F.explode(tokens_of(df, columns[0])).alias("token"), *by)
    else:
        tagged = F.concat(*[tag(i, col) for i, col in enumerate(columns)])
        hits = df.select(F.inline(tagged), *by)
    return hits.groupBy("c", "token", *by).agg(F.count("*").alias("n"))


def _top_per_group(counts: DataFrame, limits: Mapping[tuple, int], keys: Sequence[str]) -> DataFrame:
    """The most frequent tokens of each group, ``limits`` of them; ties go to the smaller token.

    No task ever ranks a whole group: each of PARTS parts of it by hash first
    keeps as many as are wanted, and only those are ranked together.
    """
    if any(k <= 0 for k in limits.values()):
        raise ValueError("vocabulary size must be positive")
    order = [F.desc("df"), F.asc("token")]
    sizes = F.create_map(*[F.lit(x) for g, k in limits.items() for x in ("/".join(map(str, g)), k)])
    own = F.try_element_at(sizes, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    parts = counts.withColumns({"_p": F.pmod(F.xxhash64("token"), F.lit(PARTS)), "_own": own})
    for group in ([*keys, "_p"], keys):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        parts = parts.withColumn("_r", rank).filter(F.col("_r") <= F.col("_own"))
    return parts.drop("_r", "_p", "_own")


def top_k(counts: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The ``sizes[c]`` most frequent tokens of each column, from (c, token, df)."""
    return _top_per_group(counts, {(c,): k for c, k in enumerate(sizes)}, ["c"])


def vocabulary(df: DataFrame, column: str, k: int) -> DataFrame:
    """Top-k tokens with their document frequency: (token, df)."""
    return top_k(token_counts(df, [column]).withColumnRenamed("n", "df"), [k]).select("token", "df")


def presence_vector(df: DataFrame, column: str, vocab: Sequence[str], out: str = "presence") -> DataFrame:
    """Sparse 0/1 vector over a vocabulary, in its order."""
    model = CountVectorizerModel.from_vocabulary(list(vocab), inputCol="_tokens", outputCol=out, binary=True)
    return model.transform(df.withColumn("_tokens", tokens_of(df, column))).drop("_tokens")


def default_prefix(column: str) -> str:
    return column.removesuffix("_text") + "_nb"


def fit_text_models(
    df: DataFrame,
    label: str,
    sizes: Mapping[str, int],
    alpha: float = 0.5,
    prefixes: Mapping[str, str] | None = None,
    vocab: Mapping[str, Sequence[str]] | None = None,
) -> list[TextModel]:
    """One model per text column, from one scan of the labels and one of the texts.

    Only the vocabularies with their class counts, as many rows as the sizes
    add up to, come to the driver.
    """
    columns = list(sizes)
    known = df.filter(F.col(label).isNotNull())
    totals = class_counts(known, label)
    classes = list(totals)
    counts = materialise(token_counts(known, columns, [label]), "token-counts")
    every = counts.groupBy("c", "token").agg(F.sum("n").alias("df"))
    if vocab is None:
        chosen = top_k(every, [sizes[c] for c in columns])
    else:
        fixed = [(i, t) for i, c in enumerate(columns) for t in vocab[c]]
        chosen = every.join(known.sparkSession.createDataFrame(fixed, "c int, token string"), ["c", "token"])
    seen: dict[tuple[int, str], dict] = {}
    freq: dict[tuple[int, str], int] = {}
    for r in chosen.join(counts, ["c", "token"]).collect():
        seen.setdefault((r["c"], r["token"]), {})[r[label]] = r["n"]
        freq[(r["c"], r["token"])] = r["df"]
    models = []
    for i, c in enumerate(columns):
        own = [t for j, t in seen if j == i]
        tokens = sorted(own, key=lambda t: (-freq[(i, t)], t)) if vocab is None else list(vocab[c])
        if not tokens:
            raise ValueError(f"no usable tokens in {c}")
        models.append(
            TextModel(
                column=c,
                prefix=(prefixes or {}).get(c, default_prefix(c)),
                classes=classes,
                class_count=[float(n) for n in totals.values()],
                vocab=tokens,
                prob=[[_smoothed(seen.get((i, t), {}).get(k, 0), n, alpha) for t in tokens] for k, n in totals.items()],
                doc_freq=[freq.get((i, t), 0) for t in tokens],
            )
        )
    return models


def _smoothed(seen: int, n: float, alpha: float) -> float:
    return min(max((seen + alpha) / (n + 2.0 * alpha), CLIP), 1.0 - CLIP)


def _numbers(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def _array(values: Sequence[float]) -> Column:
    # one expression text instead of a call per number
    return F.expr(_numbers(values))


def _table(m: TextModel) -> Column:
    """What each token adds to each class, by the token's place; one literal text, folded when planned."""
    return F.from_json(F.lit(json.dumps(m.deltas)), "array<array<double>>")


def _outputs(m: TextModel, score: str, hits: Column, include_pred: bool) -> list[Column]:
    """Probabilities, prediction, hit count and zero-hit flag from columns ``score`` and hits."""
    p = m.prefix
    out = [
        (F.col(f"{score}_e")[i] / F.col(f"{score}_z")).alias(f"{p}_p{i}") for i in range(len(m.classes))
    ]
    if include_pred:
        # first class with the highest score
        best = F.array_position(score, F.array_max(score)).cast("int")
        out.append(F.element_at(F.array(*[F.lit(c) for c in m.classes]), best).alias(f"{p}_pred"))
    return [*out, hits.alias(f"{p}_hit_count"), (hits == 0).cast("int").alias(f"{p}_zero_hit")]


def score_texts(df: DataFrame, models: Sequence[TextModel], include_pred: bool = True) -> DataFrame:
    """Add the score columns of some models, row by row and so for streams too.

    Linear in the tokens of a text: tokens are looked up in a hash table, every
    class starts from the score of an empty text, and each vocabulary token adds
    the entry at its place. Vocabularies may have any size.
    """
    names = df.columns
    hit = {m.prefix: f"_{m.prefix}_hits" for m in models}
    score = {m.prefix: f"_{m.prefix}_score" for m in models}
    for m in models:
        df = presence_vector(df, m.column, m.vocab, f"_{m.prefix}_v")

    def summed(m: TextModel) -> Column:
        h, delta = hit[m.prefix], _table(m)
        total = F.aggregate(
            h, _array(m.base), lambda acc, i: F.zip_with(acc, F.get(delta, i), lambda a, d: a + d)
        )
        return F.when(F.size(h) == 0, _array(m.log_prior)).otherwise(total)

    # columns of their own: what is used twice below is computed once
    df = df.withColumns({hit[m.prefix]: F.unwrap_udt(f"_{m.prefix}_v")["indices"] for m in models})
    df = df.withColumns({score[m.prefix]: summed(m) for m in models})

    def powers(s: str) -> Column:
        return F.transform(s, lambda x: F.exp(x - F.array_max(s)))

    df = df.withColumns({f"{s}_e": powers(s) for s in score.values()})
    df = df.withColumns(
        {f"{s}_z": F.aggregate(f"{s}_e", F.lit(0.0), lambda a, x: a + x) for s in score.values()}
    )
    out = []
    for m in models:
        out += _outputs(m, score[m.prefix], F.size(hit[m.prefix]), include_pred)
    return df.select(*[F.col(f"`{c}`") for c in names], *out)


def score_text(df: DataFrame, m: TextModel, include_pred: bool = True) -> DataFrame:
    return score_texts(df, [m], include_pred)


class TextScoresModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds probability, prediction, hit-count and zero-hit columns per text column."""

    state = Param(Params._dummy(), "state", "fitted models, as JSON", TypeConverters.toString)
    includePred = Param(Params._dummy(), "includePred", "whether to add predictions", TypeConverters.toBoolean)

    def __init__(self, models: Sequence[TextModel] | None = None, include_pred: bool = True):
        super().__init__()
        self._setDefault(includePred=True)
        if models is not None:
            self._set(state=json.dumps([asdict(m) for m in models]), includePred=include_pred)

    @property
    def models(self) -> list[TextModel]:
        return [TextModel(**m) for m in json.loads(self.getOrDefault(self.state))]

    def _transform(self, df: DataFrame) -> DataFrame:
        return score_texts(df, self.models, self.getOrDefault(self.includePred))


class TextScores(Estimator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns one naive Bayes model per text column."""

    sizes = Param(Params._dummy(), "sizes", "vocabulary size per column, as JSON", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "smoothing", TypeConverters.toFloat)
    includePred = Param(Params._dummy(), "includePred", "whether to add predictions", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, labelCol="label", sizes=None, alpha=0.5, includePred=True):
        super().__init__()
        self._setDefault(labelCol="label", alpha=0.5, includePred=True)
        kw = {k: v for k, v in self._input_kwargs.items() if v is not None}
        if "sizes" in kw:
            kw["sizes"] = json.dumps(kw["sizes"])
        self._set(**kw)

    def _fit(self, df: DataFrame) -> TextScoresModel:
        models = fit_text_models(
            df, self.getLabelCol(), json.loads(self.getOrDefault(self.sizes)), self.getOrDefault(self.alpha)
        )
        return TextScoresModel(models, self.getOrDefault(self.includePred))


def to_tables(spark: SparkSession, models: Sequence[TextModel]) -> tuple[DataFrame, DataFrame]:
    """Fitted parameters as data: one table of classes, one of (class, token) probabilities."""
    classes = [
        (m.column, m.prefix, i, str(c), n, lp)
        for m in models
        for i, (c, n, lp) in enumerate(zip(m.classes, m.class_count, m.log_prior))
    ]
    tokens = [
        (m.column, i, j, t, row[j], math.log(row[j]), math.log(1.0 - row[j]))
        for m in models
        for i, row in enumerate(m.prob)
        for j, t in enumerate(m.vocab)
    ]
    return (
        spark.createDataFrame(classes, "column string, prefix string, k int, class string, n double, log_prior double"),
        spark.createDataFrame(
            tokens, "column string, k int, idx int, token string, p double, log_p double, log_not_p double"
        ),
    )


def from_tables(classes: DataFrame, tokens: DataFrame, class_type=int) -> list[TextModel]:
    """Models from stored parameter tables; a missing class or token row is an error."""
    by_col: dict[str, list] = {}
    for r in classes.orderBy("column", "k").collect():
        by_col.setdefault(r["column"], []).append(r)
    rows: dict[str, dict] = {}
    for r in tokens.select("column", "k", "idx", "token", "p").collect():
        rows.setdefault(r["column"], {})[(r["k"], r["idx"])] = (r["token"], r["p"])
    models = []
    for col, cls in by_col.items():
        mine = rows.get(col, {})
        size = 1 + max((j for _, j in mine), default=-1)
        if size == 0 or len(mine) != size * len(cls):
            raise ValueError(f"stored parameters of {col} are incomplete")
        models.append(
            TextModel(
                column=col,
                prefix=cls[0]["prefix"],
                classes=[class_type(r["class"]) for r in cls],
                class_count=[r["n"] for r in cls],
                vocab=[mine[(0, j)][0] for j in range(size)],
                prob=[[mine[(i, j)][1] for j in range(size)] for i in range(len(cls))],
            )
        )
    return models


def predict_texts(spark: SparkSession, model: TextModel, texts: Sequence[str | None]) -> DataFrame:
    """Scores of single texts; the one-text forms are this with one entry."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i long, `{model.column}` string")
    return score_text(rows, model)


@dataclass
class FoldCounts:
    """Token counts of the rows outside each fold, enough for every smaller vocabulary too."""

    columns: list
    classes: list
    n_folds: int
    # (fold, class) -> rows in the fold
    rows_in: dict
    # (fold, column) -> (token, df, {class: n}), most frequent token first
    ranked: dict

    def models(self, sizes: Mapping[str, int], alpha: float = 0.5) -> dict[int, list[TextModel]]:
        """For every fold the models fitted on all other folds."""
        return {f: [self._model(f, col, k, alpha) for col, k in sizes.items()] for f in range(self.n_folds)}

    def _model(self, f: int, col: str, k: int, alpha: float) -> TextModel:
        outside = [g for g in range(self.n_folds) if g != f]
        n = {c: float(sum(self.rows_in.get((g, c), 0) for g in outside)) for c in self.classes}
        n = {c: m for c, m in n.items() if m > 0}
        mine = self.ranked.get((f, self.columns.index(col)), [])[:k]
        if not mine:
            raise ValueError(f"no usable tokens in {col}")
        return TextModel(
            column=col,
            prefix=default_prefix(col),
            classes=list(n),
            class_count=list(n.values()),
            vocab=[t for t, _, _ in mine],
            prob=[[_smoothed(seen.get(c, 0), m, alpha) for _, _, seen in mine] for c, m in n.items()],
            doc_freq=[df for _, df, _ in mine],
        )


def count_by_fold(
    df: DataFrame, label: str, fold: str, n_folds: int, sizes: Mapping[str, int]
) -> FoldCounts:
    """Counts for all folds from one scan of the texts, the ``sizes`` largest per fold and column.

    One row per (column, token, fold, class) is counted and written; each goes to
    the training rows of all other folds, where they are added up again.
    """
    columns = list(sizes)
    known = df.filter(F.col(label).isNotNull())
    rows_in = {
        (r[fold], r[label]): r["n"] for r in known.groupBy(fold, label).agg(F.count("*").alias("n")).collect()
    }
    classes = sorted({c for _, c in rows_in})
    others = F.array_remove(F.array(*[F.lit(f) for f in range(n_folds)]), F.col(fold))
    counts = token_counts(known, columns, [fold, label]).withColumn("f", F.explode(others))
    counts = materialise(counts.groupBy("f", "c", "token", label).agg(F.sum("n").alias("n")), "fold-counts")
    every = counts.groupBy("f", "c", "token").agg(F.sum("n").alias("df"))
    limits = {(f, c): k for f in range(n_folds) for c, k in enumerate(sizes.values())}
    best = _top_per_group(every, limits, ["f", "c"]).join(counts, ["f", "c", "token"])
    found: dict[tuple, tuple] = {}
    for r in best.collect():
        key = (r["f"], r["c"], r["token"])
        found.setdefault(key, (r["token"], r["df"], {}))[2][r[label]] = r["n"]
    ranked: dict[tuple, list] = {}
    for (f, c, _), entry in sorted(found.items(), key=lambda kv: (-kv[1][1], kv[1][0])):
        ranked.setdefault((f, c), []).append(entry)
    return FoldCounts(columns, classes, n_folds, rows_in, ranked)


# Bytes of one hash, each the draw of a row for one seed.
DRAWS = 32


def training_sides(id_col: str, seeds: int, train_size: float = 0.8) -> Column:
    """For each seed 0, 1, .. whether a row is a training row: 1 or 0, each from a byte of a hash of its id.

    The share of training rows is ``train_size`` to the next 1/256.
    """
    limit, parts = round(train_size * 256), []
    for block in range(0, seeds, DRAWS):
        here = F.sha2(F.concat(F.lit(f"{block // DRAWS}:"), F.col(id_col).cast("string")), 256)
        draws = range(min(DRAWS, seeds - block))
        parts += [(F.conv(F.substring(here, 2 * i + 1, 2), 16, 10).cast("int") < limit).cast("int") for i in draws]
    return F.array(*parts)


@dataclass
class RepeatedModels:
    """Models of one text column for many random splits; lists run over seeds, then over classes."""

    classes: list
    prior: list
    base: list
    vocab: list
    # per token of any seed's vocabulary: what it adds to (seed, class), and whether it is in the seed's vocabulary
    deltas: list
    within: list

    def predicted(self, df: DataFrame, column: str, out: str = "preds") -> DataFrame:
        """The place of the predicted class for each seed: one look-up of a text's tokens, no join."""
        n, flat = len(self.classes), lambda rows: [x for r in rows for x in r]
        table = F.from_json(F.lit(json.dumps(self.deltas)), "array<array<double>>")
        inside = F.from_json(F.lit(json.dumps(self.within)), "array<array<int>>")
        add = lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)
        names = df.columns
        df = presence_vector(df, column, self.vocab, "_v").withColumn("_hits", F.unwrap_udt("_v")["indices"])
        df = df.withColumn("_sum", F.aggregate("_hits", _array(flat(self.base)), lambda a, i: add(a, F.get(table, i))))
        none = F.from_json(F.lit(json.dumps([0] * len(self.prior))), "array<int>")
        df = df.withColumn("_seen", F.aggregate("_hits", none, lambda a, i: add(a, F.get(inside, i))))
        prior = _array(flat(self.prior))

        def best(s: Column) -> Column:
            score = F.when(F.get("_seen", s) == 0, F.slice(prior, s * n + 1, n)).otherwise(F.slice("_sum", s * n + 1, n))
            score = F.transform(score, lambda x: F.round(x, 9))
            return (F.array_position(score, F.array_max(score)) - 1).cast("int")

        seeds = F.sequence(F.lit(0), F.lit(len(self.prior) - 1))
        return df.withColumn(out, F.transform(seeds, best)).select(*[F.col(f"`{c}`") for c in names], out)


def fit_repeated(df: DataFrame, label: str, column: str, sides: str, seeds: int, k: int, alpha: float = 0.5) -> RepeatedModels:
    """The models of all splits from one scan of the tokens.

    ``sides`` holds a 1 for each seed whose training rows a row belongs to. Counts of a
    (token, class) are sums along it, one per seed; vocabularies are ranked from them.
    The driver receives seeds x classes totals and seeds x k x classes counts.
    """
    sums = lambda: F.array(*[F.sum(F.get(sides, F.lit(i))) for i in range(seeds)])
    known = df.where(F.col(label).isNotNull())
    totals = {r[label]: r["n"] for r in known.groupBy(label).agg(sums().alias("n")).collect()}
    classes = sorted(totals)
    hits = known.select(label, sides, F.explode(tokens_of(known, column)).alias("token"))
    counts = materialise(hits.groupBy("token", label).agg(sums().alias("n")), "repeated-counts")
    each = counts.select("token", label, F.posexplode("n").alias("seed", "c")).where("c > 0")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("df"), F.asc("token")))
    top = each.groupBy("seed", "token").agg(F.sum("c").alias("df")).withColumn("_r", rank).where(F.col("_r") <= k)
    found = each.join(F.broadcast(top.select("seed", "token")), ["seed", "token"]).collect()
    seen: dict[tuple, dict] = {}
    for r in found:
        seen.setdefault((r["seed"], r["token"]), {})[r[label]] = r["c"]
    vocab = sorted({t for _, t in seen})
    prior = [[math.log(max(totals[c][s], CLIP) / max(1, sum(totals[d][s] for d in classes))) for c in classes] for s in range(seeds)]
    base = [list(row) for row in prior]
    deltas, within = [], []
    for t in vocab:
        row, here = [], []
        for s in range(seeds):
            by = seen.get((s, t))
            here.append(int(by is not None))
            for i, c in enumerate(classes):
                p = _smoothed(by.get(c, 0), totals[c][s], alpha) if by else None
                row.append(math.log(p) - math.log(1.0 - p) if by else 0.0)
                if by:
                    base[s][i] += math.log(1.0 - p)
        deltas.append(row)
        within.append(here)
    return RepeatedModels(classes, prior, base, vocab, deltas, within)
