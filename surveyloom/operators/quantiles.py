"""Exact, interpolated quantiles whose memory does not grow with the data."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.session import materialise

_ACCURACY = 10_000


def quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], *, approx: bool = False
) -> dict[str, list[float | None]]:
    """Quantiles per column with linear interpolation; NULLs are ignored, empty columns give None.

    Rows are counted per column and value, so a heavy value is one row. The
    counts are laid out by ranges of values and written; the sums per range tell
    which range holds a wanted rank, and only there the rows are added up. Two
    passes over the counts, whatever the values are.
    """
    cols = list(wanted)
    if not cols:
        return {}
    num = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    if approx:
        row = num.agg(
            *[F.percentile_approx(c, list(wanted[c]), _ACCURACY).alias(c) for c in cols]
        ).first()
        return {c: list(row[c] or [None] * len(wanted[c])) for c in cols}

    tagged = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(cols)])
    counts = num.select(F.inline(tagged)).where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, "c", "v").withColumn("part", F.spark_partition_id())
    stored = materialise(ranged, "value-counts")
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in stored.groupBy("c", "part").agg(F.sum("n").alias("n")).orderBy("c", "part").collect():
        sums.setdefault(r["c"], []).append((r["part"], r["n"]))

    # (column, rank) -> (range, rank within the range)
    places: dict[tuple[int, int], tuple[int, int]] = {}
    for i, c in enumerate(cols):
        n = sum(k for _, k in sums.get(i, []))
        for q in wanted[c] if n else []:
            for rank in (math.floor(q * (n - 1)), math.ceil(q * (n - 1))):
                below = 0
                for part, k in sums[i]:
                    if rank < below + k:
                        places[(i, rank)] = (part, rank - below)
                        break
                    below += k
    values = _read(stored, places)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        n = sum(k for _, k in sums.get(i, []))
        out[c] = [_between(values, i, q * (n - 1)) if n else None for q in wanted[c]]
    return out


def _read(stored: DataFrame, places: dict) -> dict[tuple[int, int], float]:
    """The value at each place, from one pass over the ranges that hold one."""
    if not places:
        return {}
    spark = stored.sparkSession
    rows = [(i, part, rank, local) for (i, rank), (part, local) in places.items()]
    asked = spark.createDataFrame(rows, "c int, part int, rank long, local long")
    inside = stored.join(F.broadcast(asked.select("c", "part").distinct()), ["c", "part"])
    so_far = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("n").over(so_far))
    at = (F.col("local") >= F.col("upto") - F.col("n")) & (F.col("local") < F.col("upto"))
    found = inside.join(F.broadcast(asked), ["c", "part"]).where(at).select("c", "rank", "v").collect()
    return {(r["c"], r["rank"]): r["v"] for r in found}


def _between(values: dict, i: int, pos: float) -> float:
    low, high = values[(i, math.floor(pos))], values[(i, math.ceil(pos))]
    part = pos - math.floor(pos)
    return low if low == high else (1 - part) * low + part * high


def medians(df: DataFrame, cols: Sequence[str], **kwargs) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, {c: [0.5] for c in cols}, **kwargs).items()}


def upper_caps(df: DataFrame, cols: Sequence[str], q: float = 0.99, **kwargs) -> dict[str, int | None]:
    """Ceiling of a high quantile after negatives count as zero; None where there is no finite one."""
    # greatest() skips NULLs, so the NULL test comes first
    x = {c: F.col(c).cast("double") for c in cols}
    floor = df.select(*[F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))).alias(c) for c, v in x.items()])
    found = quantiles(floor, {c: [q] for c in cols}, **kwargs)
    return {
        c: None if v[0] is None or not math.isfinite(v[0]) else math.ceil(v[0]) for c, v in found.items()
    }
