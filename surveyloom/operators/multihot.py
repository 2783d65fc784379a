"""Multi-select cells to indicator columns."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.text import split_multiselect


def slug(text: str) -> str:
    return re.sub(r"[^0-9a-zA-Z]+", "_", text).strip("_").lower()


def indicator_name(column: str, category: str) -> str:
    return f"{slug(column)[:24]}__{slug(category)}"


def indicator_names(pairs: Sequence[tuple[str, str]]) -> list[str]:
    """One name per (column, category); equal names are numbered from 2 in the order given."""
    names: list[str] = []
    for column, category in pairs:
        base = name = indicator_name(column, category)
        n = 1
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names.append(name)
    return names


def _options(df: DataFrame, cols: Sequence[str], sep: str, keep: Sequence[str] = ()) -> DataFrame:
    """(c, item) of every option in every cell, all columns in one pass."""

    def tag(c: str):
        items = F.array_distinct(split_multiselect(F.col(c), sep))
        return F.transform(items, lambda item: F.struct(F.lit(c).alias("c"), item.alias("item")))

    pairs = df.select(*keep, F.explode(F.concat(*[tag(c) for c in cols])).alias("p"))
    return pairs.select("p.c", "p.item", *keep)


def _collected(rows: DataFrame, most: int | None) -> list:
    """Rows of (column, option), which become columns; more than ``most`` are an error."""
    got = rows.collect() if most is None else rows.limit(most + 1).collect()
    if most is not None and len(got) > most:
        raise ValueError(f"the columns have more than {most} options")
    return got


def categories(
    df: DataFrame, cols: Sequence[str], sep: str = ",", most: int | None = None
) -> dict[str, list[str]]:
    """Sorted distinct options per column.

    Options repeat a lot, so partial aggregation leaves little to shuffle.
    """
    rows = _collected(_options(df, cols, sep).distinct(), most)
    return {c: sorted(r["item"] for r in rows if r["c"] == c) for c in cols}


class _MultiHotParams(HasInputCols):
    sep = Param(Params._dummy(), "sep", "separator of the options", TypeConverters.toString)
    prefixes = Param(
        Params._dummy(), "prefixes", "names the indicator columns start from", TypeConverters.toListString
    )

    def names(self) -> list[str]:
        return self.getOrDefault(self.prefixes) if self.isSet(self.prefixes) else self.getInputCols()


class MultiHotModel(Model, _MultiHotParams, DefaultParamsReadable, DefaultParamsWritable):
    """0/1 column per known option; unknown options are ignored."""

    encoders = Param(Params._dummy(), "encoders", "options per column, as JSON", TypeConverters.toString)

    def __init__(self, cols=None, encoders=None, sep=",", prefixes=None):
        super().__init__()
        self._setDefault(sep=",")
        if cols is not None:
            self._set(inputCols=list(cols), encoders=json.dumps(encoders), sep=sep)
        if prefixes is not None:
            self._set(prefixes=list(prefixes))

    @property
    def options(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault(self.encoders))

    def output_columns(self) -> list[str]:
        return indicator_names([(p, o) for c, p in zip(self.getInputCols(), self.names()) for o in self.options[c]])

    def _transform(self, df: DataFrame) -> DataFrame:
        sep = self.getOrDefault(self.sep)
        lists = {f"_items_{i}": split_multiselect(F.col(c), sep) for i, c in enumerate(self.getInputCols())}
        known = [(f"_items_{i}", o) for i, c in enumerate(self.getInputCols()) for o in self.options[c]]
        flags = [
            F.array_contains(items, o).cast("int").alias(name)
            for (items, o), name in zip(known, self.output_columns())
        ]
        return df.withColumns(lists).select(*[F.col(f"`{c}`") for c in df.columns], *flags)


class MultiHot(Estimator, _MultiHotParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, sep=",", prefixes=None):
        super().__init__()
        self._setDefault(sep=",")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> MultiHotModel:
        cols, sep = self.getInputCols(), self.getOrDefault(self.sep)
        prefixes = self.getOrDefault(self.prefixes) if self.isSet(self.prefixes) else None
        return MultiHotModel(cols, categories(df, cols, sep), sep, prefixes)


def categories_by_fold(
    df: DataFrame, cols: Sequence[str], fold: str, n_folds: int, sep: str = ",", most: int | None = None
) -> dict[int, dict[str, list[str]]]:
    """For every fold the options that occur in the other folds, from one scan."""
    pairs = _options(df, cols, sep, [fold])
    seen = F.collect_set(fold).alias("folds")
    rows = _collected(pairs.groupBy("c", "item").agg(seen), most)

    def outside(f: int, c: str) -> list[str]:
        return sorted(r["item"] for r in rows if r["c"] == c and any(g != f for g in r["folds"]))

    return {f: {c: outside(f, c) for c in cols} for f in range(n_folds)}
