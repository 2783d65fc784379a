"""Numbers, ordinal answers and bounds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.text import SPACE

# Fixed value: written numbers a lenient parser accepts; Spark alone would also take "1d" and "1f".
NUMBER = r"(?i)^\s*[-+]?(inf(inity)?|nan|(\d+\.?\d*|\.\d+)(e[-+]?\d+)?)\s*$"


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def to_number(c: Column) -> Column:
    """Written number as double; anything else, and NaN, is NULL."""
    s = c.cast("string")
    return nan_to_null(F.when(s.rlike(NUMBER), s).try_cast("double"))


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def lookup(c: Column, table: Mapping, dtype: str | None = None) -> Column:
    """Value of a stripped answer in a small fixed table; unknown answers are NULL."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    value = F.try_element_at(pairs, strip(c))
    return value.cast(dtype) if dtype else value


def label_id(c: Column, table: Mapping) -> Column:
    return lookup(c, table, "int")


def label_title(c: Column, titles: Mapping) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    return F.try_element_at(pairs, c.cast("int"))


def bounded(x: Column, lo, hi) -> Column:
    """Values outside the bounds are missing, not clipped."""
    return F.when(x.between(F.lit(float(lo)), F.lit(float(hi))), x)


def non_negative(x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def clip(x: Column, lo=None, hi=None) -> Column:
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def half_even(x: Column) -> Column:
    """Round to the nearest integer, ties to even; infinities pass through."""
    return F.when(F.abs(x) < F.lit(2.0**52), F.bround(x, 0)).otherwise(x)


def to_count(x: Column, upper) -> Column:
    """Clip to [0, upper] and round half to even; without an upper bound nothing changes."""
    return non_negative(x) if upper is None else F.bround(clip(x, 0, upper), 0)


# Largest double below 2^63.
_INT64 = 9223372036854774784.0


def to_long(x: Column, lo=None, hi=None) -> Column:
    x = clip(finite(x), lo, hi)
    return half_even(clip(x, -_INT64, _INT64)).try_cast("long")
