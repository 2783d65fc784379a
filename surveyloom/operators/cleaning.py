"""Row and column cleaning operators and their audit counts."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.scales import NUMBER
from surveyloom.operators.quantiles import medians


def missing_count(cols: Iterable[str]) -> Column:
    """Number of NULL cells in a row."""
    return reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in cols])


def drop_sparse_rows(df: DataFrame, limit: int = 4) -> DataFrame:
    """Keep rows with fewer than ``limit`` NULL cells, counted over all columns."""
    return df.filter(missing_count(df.columns) < limit)


def fill_values(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """NULLs to a constant per column; None leaves a column as it is."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(float(v)).cast(df.schema[c].dataType)) for c, v in values.items() if v is not None}
    )


def first_known(*sources: Mapping[str, float | None]) -> dict[str, float | None]:
    """Per column the first value that is not None, in the order of the sources."""
    cols = dict.fromkeys(c for s in sources for c in s)
    return {c: next((s[c] for s in sources if s.get(c) is not None), None) for c in cols}


def numeric_columns(df: DataFrame, cols: Sequence[str]) -> set[str]:
    """Columns all of whose known cells are written numbers; numeric types qualify as they are."""
    cols = [c for c in cols if c in df.columns]
    typed = {
        c for c in cols if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))
    }
    texts = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return typed
    row = df.agg(*[F.count_if(~F.col(c).rlike(NUMBER)).alias(c) for c in texts]).first()
    return typed | {c for c in texts if row[c] == 0}


def audit(df: DataFrame, checks: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """Counts of rows that meet each condition, in one pass.

    ``checks`` are (step, column, metric, condition); the result has one row
    per check: (step, column, metric, value).
    """
    counted = df.agg(*[F.count_if(cond).alias(f"m{i}") for i, (*_, cond) in enumerate(checks)])
    rows = F.array(
        *[
            F.struct(
                F.lit(step).alias("step"),
                F.lit(column).alias("column"),
                F.lit(metric).alias("metric"),
                F.col(f"m{i}").alias("value"),
            )
            for i, (step, column, metric, _) in enumerate(checks)
        ]
    )
    return counted.select(F.inline(rows))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value; NULL is a value of its own."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


class _FillParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "number columns", TypeConverters.toListString)
    batch = Param(Params._dummy(), "batch", "whether the rows at hand are asked first", TypeConverters.toBoolean)


class FillsModel(Model, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fills NULLs with the median of the rows at hand, else that of the training rows, else 0.

    A stream has no rows at hand: set ``batch`` to false there, or one record would
    be filled from itself.
    """

    values = Param(Params._dummy(), "values", "training medians as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(batch=True)

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = [c for c in self.getOrDefault(self.inputCols) if c in df.columns]
        own = medians(df, columns) if self.getOrDefault(self.batch) and not df.isStreaming else {}
        fills = first_known(own, json.loads(self.getOrDefault(self.values)), dict.fromkeys(columns, 0.0))
        return fill_values(df, {c: fills[c] for c in columns})


class Fills(Estimator, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the medians of the training rows as a stage of a pipeline."""

    @keyword_only
    def __init__(self, *, inputCols=None, batch=True):
        super().__init__()
        self._setDefault(batch=True)
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> FillsModel:
        values = json.dumps(medians(df, self.getOrDefault(self.inputCols)))
        model = FillsModel()._set(values=values)
        return self._copyValues(model)
