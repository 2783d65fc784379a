"""What several corpus operators share."""

from __future__ import annotations

import importlib
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.session import fresh_path


def by_value(*modules: str) -> None:
    """Ships these modules with the functions that use them: executors need no copy of the library."""
    for name in modules:
        cloudpickle.register_pickle_by_value(importlib.import_module(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and still there after executors go."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Jobs inside hand at most ``rows`` rows at once to Python; whole texts need memory for each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same_row(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Equality of keys, null equal to null; Spark hashes on it like on plain equality."""
    return every([a[n].eqNullSafe(b[n]) for n in names])


def every(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


BUCKETS = 1024


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str):
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are ordered by (bucket, *order). Sums per bucket, and per run of BUCKETS
    buckets, are added up first, so no task sees a whole group: one bucket of it,
    one run of bucket sums, or the sums of its runs.
    """
    base, far, run = fresh(df, "_base"), fresh(df, "_far"), fresh(df, "_run")
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias(base)).withColumn(run, F.floor(F.col(bucket) / BUCKETS))
    runs = sums.groupBy(*group, run).agg(F.sum(base).alias(far))
    runs = runs.withColumn(far, _sum_before(far, group, [run]))
    sums = _met(sums.withColumn(base, _sum_before(base, [*group, run], [bucket])), runs, [*group, run], far)
    sums = sums.withColumn(base, F.col(base) + F.col(far)).drop(run, far)
    inner = df.withColumn(far, _sum_before(value, [*group, bucket], order))
    met = _met(inner, sums, [*group, bucket], base)
    return met.select(*df.columns, (F.col(base) + F.col(far)).alias(out))


def _sum_before(value: str, group: list[str], order: list[str]) -> Column:
    return F.coalesce(F.sum(value).over(_before(group, order)), F.lit(0))


def _met(left: DataFrame, right: DataFrame, on: list[str], take: str) -> DataFrame:
    """``left`` with the column ``take`` of ``right``, keys null-safe."""
    keyed = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], take)
    same = every([left[c].eqNullSafe(keyed[f"_k{i}"]) for i, c in enumerate(on)])
    return left.join(keyed, same).select(*left.columns, take)


def _before(group: list[str], order: list[str]):
    return (
        Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )


def numbered(df: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """Adds ``out``: the row's place (from 0) in the order; sorted by ranges, no single task.

    Only rows per range meet in one task, as many as there are ranges.
    """
    mark, part = fresh(df, "_mark"), fresh(df, "_part")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    t = written(ranged.withColumn(mark, F.monotonically_increasing_id()), name)
    t = t.withColumn(part, F.shiftright(mark, 33))
    ends = t.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    base = F.coalesce(F.sum("n").over(_before([], [part])), F.lit(0))
    ends = ends.select(F.col(part).alias("_p"), base.alias("_b"))
    place = (F.col("_b") + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))).alias(out)
    return t.join(ends, F.col(part) == F.col("_p")).select(*df.columns, place)
