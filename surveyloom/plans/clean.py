"""Cleaning plans: from a raw survey table to a typed, filled table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions import scales as S
from surveyloom.functions.money import bound_money, parse_money
from surveyloom.operators.cleaning import (
    audit,
    drop_sparse_rows,
    fill_values,
    first_known,
    numeric_columns,
)
from surveyloom.operators.quantiles import medians, upper_caps
from surveyloom.schema import MISSING, RAW_TO_CANONICAL, SURVEY, SURVEY_ALTERNATIVE, SURVEY_SCRIPT, CleanSpec
from surveyloom.session import materialise, spread
from surveyloom.sources.tables import ensure_survey_schema, headers, is_cleaned, read_csv, typed_cleaned, write_csv


@dataclass
class Cleaned:
    """A cleaned table with the values that were fitted on the way."""

    df: DataFrame
    caps: dict
    fills: dict
    audit: DataFrame | None = None


def _labelled(df: DataFrame, spec: CleanSpec, relabel: bool) -> DataFrame:
    if spec.class_col not in df.columns or (is_cleaned(df, spec) and not relabel):
        return df
    title = F.nullif(S.strip(F.col(spec.class_col)), F.lit("nan"))
    return df.withColumn(spec.class_col, title).withColumn(
        spec.label_col, S.label_id(F.col(spec.class_col), spec.label_map)
    )


def _typed(df: DataFrame, spec: CleanSpec, as_numbers: set[str]) -> DataFrame:
    """Every raw answer as a double before bounds and caps.

    ``as_numbers`` lists columns that hold written numbers and skip the
    ordinal map or the money parser.
    """
    out = {}
    for c in spec.ordinals:
        col = F.col(c)
        out[c] = S.to_number(col) if c in as_numbers else S.lookup(col, spec.ordinal_map, "double")
    money = F.col(spec.money)
    out[spec.money] = S.to_number(money) if spec.money in as_numbers else parse_money(money.cast("string"))
    for c in spec.counts:
        x = S.to_number(F.col(c))
        out[c] = S.finite(x) if spec.finite_counts else x
    for c in spec.scales:
        out[c] = S.to_number(F.col(c))
    return df.withColumns({c: e for c, e in out.items() if c in df.columns})


def _bounded(df: DataFrame, spec: CleanSpec, caps: Mapping) -> DataFrame:
    out = {c: S.bounded(F.col(c), *spec.bounds(c)) for c in (*spec.scales, *spec.ordinals)}
    out[spec.money] = bound_money(F.col(spec.money), spec.money_cap)
    out |= {c: S.to_count(F.col(c), caps[c]) for c in spec.counts if c in caps}
    return df.withColumns({c: e for c, e in out.items() if c in df.columns})


def _range_checks(spec: CleanSpec, caps: Mapping, present: set) -> list:
    money = F.col(spec.money)
    checks = [
        ("payment", spec.money, "negative_to_zero", money < 0),
        ("payment", spec.money, "capped", money > spec.money_cap),
    ]
    for c in spec.counts:
        x = S.non_negative(F.col(c))
        checks.append(("count", c, "negative_to_zero", F.col(c) < 0))
        if caps.get(c) is not None:
            checks.append(("count", c, "capped", x > S.to_count(x, caps[c])))
    for c in (*spec.scales, *spec.ordinals):
        lo, hi = spec.bounds(c)
        checks.append(("scale", c, "out_of_range", (F.col(c) < lo) | (F.col(c) > hi)))
    return [check for check in checks if check[1] in present]


def clean(
    raw: DataFrame,
    spec: CleanSpec = SURVEY,
    *,
    complete: bool = True,
    drop_sparse: bool = True,
    drop_unlabelled: bool = False,
    relabel: bool = False,
    numbers: str = "map",
    fill: str = "batch",
    train_fills: Mapping | None = None,
    integers: bool = True,
    staged: bool = True,
    with_audit: bool = False,
    approx: bool = False,
) -> Cleaned:
    """Clean a raw table.

    numbers   "map": answers go through the ordinal map and the money parser;
              "auto": columns that hold only written numbers are taken as numbers.
    fill      "batch": medians of the rows kept here, then the defaults;
              "train": ``train_fills``, then the defaults;
              "batch_train": batch medians, then ``train_fills``, then 0;
              "default": the defaults only. The last two need no look at the
              other rows and "train" and "default" suit streams.
    staged    write the typed rows once, so that the passes for caps, medians
              and the result do not parse the texts again.
    """
    df = ensure_survey_schema(raw, spec) if complete else raw
    df = _labelled(df, spec, relabel)
    as_numbers: set[str] = set()
    if numbers == "auto":
        as_numbers = numeric_columns(df, [*spec.ordinals, spec.money, spec.id_col])
    if spec.id_col in as_numbers:
        df = df.withColumn(spec.id_col, S.to_number(F.col(spec.id_col)))
    looks_back = fill.startswith("batch") or None in spec.counts.values()
    if staged and looks_back:
        typed = materialise(_typed(spread(df), spec, as_numbers), "typed")
    else:
        typed = _typed(df, spec, as_numbers)

    open_counts = [c for c, u in spec.counts.items() if u is None and c in typed.columns]
    caps = {c: u for c, u in spec.counts.items() if u is not None}
    if open_counts:
        caps |= upper_caps(typed, open_counts, spec.upper_q, approx=approx)
    bounded = _bounded(typed, spec, caps)

    kept = bounded
    if drop_unlabelled and spec.label_col in kept.columns:
        kept = kept.filter(F.col(spec.label_col).isNotNull())
    if drop_sparse:
        kept = drop_sparse_rows(kept, spec.max_missing)

    numeric = [c for c in spec.numerics if c in kept.columns]
    if spec.id_col in as_numbers:
        numeric.append(spec.id_col)
    batch = medians(kept, numeric, approx=approx) if fill.startswith("batch") else {}
    sources = {
        "batch": [batch, spec.defaults],
        "train": [train_fills or {}, spec.defaults],
        "batch_train": [batch, train_fills or {}, dict.fromkeys(numeric, 0.0)],
        "default": [spec.defaults],
    }[fill]
    fills = {c: v for c, v in first_known(*sources).items() if c in numeric}
    filled = fill_values(kept, fills)
    if integers:
        longs = {}
        for c in spec.discretes:
            lo, hi = spec.bounds(c)
            longs[c] = S.to_long(F.col(c), lo, hi)
        filled = filled.withColumns({c: e for c, e in longs.items() if c in filled.columns})
    texts = [c for c in spec.texts if c in filled.columns]
    result = filled.fillna(MISSING, texts)

    report = None
    if with_audit:
        report = audit(typed, [("rows", "*", "raw", F.lit(True)), *_range_checks(spec, caps, set(typed.columns))]).union(
            audit(
                kept,
                [("rows", "*", "kept", F.lit(True))]
                + [("missing", c, "before_fill", F.col(c).isNull()) for c in [*numeric, *texts]],
            )
        ).union(
            audit(result, [("missing", c, "after_fill", F.col(c).isNull()) for c in [*numeric, *texts]])
        )
    return Cleaned(result, caps, fills, report)


def clean_final(raw: DataFrame, drop_sparse: bool = True, **kwargs) -> Cleaned:
    """Plan of the final model: fixed count caps, defaults for empty columns."""
    return clean(raw, SURVEY, drop_sparse=drop_sparse, **kwargs)


def clean_script(raw: DataFrame, **kwargs) -> Cleaned:
    """Plan of the batch script: count caps from the data, no defaults."""
    return clean(raw, SURVEY_SCRIPT, complete=False, relabel=True, with_audit=True, **kwargs)


def clean_alternative(raw: DataFrame, **kwargs) -> Cleaned:
    """Plan of the alternative models: rows without a label go, every number gets its median,
    every other column the missing marker; columns the survey does not know are filled alike."""
    spec = SURVEY_ALTERNATIVE
    done = clean(
        raw, spec, complete=False, drop_sparse=False, drop_unlabelled=True, relabel=True,
        numbers="auto", integers=False, **kwargs,
    )
    extras = [c for c in done.df.columns if c not in spec.expected and c != spec.label_col]
    numbers = numeric_columns(done.df, extras)
    df = done.df.withColumns({c: S.to_number(F.col(c)) for c in numbers})
    if numbers:
        found = medians(df, sorted(numbers))
        df, done.fills = fill_values(df, found), done.fills | found
    rest = [c for c in [*extras, spec.id_col] if c in df.columns and c not in numbers]
    done.df = df.fillna(MISSING, rest)
    return done


def clean_for_prediction(raw: DataFrame, train_fills: Mapping, **kwargs) -> Cleaned:
    """Plan of the alternative models at scoring: every row stays; batch, then training medians."""
    return clean(
        raw, SURVEY_ALTERNATIVE, drop_sparse=False, relabel=True, numbers="auto",
        fill="batch_train", train_fills=train_fills, integers=False, **kwargs,
    )


def clean_csv(spark: SparkSession, source: str, target: str, plan=clean_alternative) -> DataFrame:
    """Raw CSV to cleaned CSV."""
    cleaned = plan(read_csv(spark, source)).df
    write_csv(cleaned, target)
    return cleaned


def resolve_training(df: DataFrame, spec: CleanSpec = SURVEY) -> DataFrame:
    """A table with labels is taken as cleaned, any other one is cleaned first."""
    return df if is_cleaned(df, spec) else clean(df, spec).df


def resolve_folder(
    spark: SparkSession, path: str, spec: CleanSpec = SURVEY, names: Mapping = RAW_TO_CANONICAL, multi_line: bool = True
) -> DataFrame:
    """Cleaned rows of a folder of raw and cleaned CSV files, told apart by the header of each file.

    Files with the label column are taken as cleaned, all others are cleaned
    together; the parts are united by column name. Files of one header are read as
    one table, so there are as many reads as headers, not files.
    """
    raw, done = [], []
    for r in headers(spark, path).orderBy("header").collect():
        df = read_csv(spark, r["files"], names, multi_line)
        (done if is_cleaned(df, spec) else raw).append(df)
    union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    parts = [typed_cleaned(union(done), spec)] if done else []
    if raw:
        parts.append(clean(union(raw), spec).df)
    if not parts:
        raise ValueError(f"no CSV files in {path}")
    return union(parts)
