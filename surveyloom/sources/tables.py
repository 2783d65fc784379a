"""Reading and writing survey tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.schema import CANONICAL_TO_RAW, NULL_TOKENS, RAW_TO_CANONICAL, SURVEY, CleanSpec
from surveyloom.session import materialise


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by a map; columns it does not know keep their names."""
    return df.toDF(*[names.get(c, c) for c in df.columns])


def null_tokens_to_null(df: DataFrame, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """Cells whose whole text is a missing-value marker become NULL in string columns."""
    tokens = list(tokens)
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}

    def cell(name: str):
        c = F.col(f"`{name}`")
        if name not in strings:
            return c
        return F.when(~((c == "") | c.isin(tokens)), c).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def read_csv(
    spark: SparkSession,
    path: str,
    names: Mapping[str, str] = RAW_TO_CANONICAL,
    multi_line: bool = True,
) -> DataFrame:
    """Header CSV, every column text, markers as NULL, canonical names.

    Types are never inferred: that would read the file twice and depends on
    its content. ``multi_line=False`` lets Spark split large files where no
    cell holds a line break.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    return rename(null_tokens_to_null(raw), names)


def read_csv_checked(
    spark: SparkSession, path: str, names: Mapping[str, str] = RAW_TO_CANONICAL, multi_line: bool = True,
    columns: Sequence[str] | None = None, line: str = "line",
) -> tuple[DataFrame, DataFrame]:
    """(records, damaged): a header CSV with the lines of too few or too many cells kept apart.

    Both have a ``row_id`` that grows in file order. Damaged lines have their text
    in ``line`` and the cells that could be told. ``columns`` are the raw names in
    file order; without them the header of one of the files tells. The file is
    parsed once and written as a table, since all its cells are needed to tell.
    """
    plain = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("encoding", "UTF-8")
    columns = list(columns or plain.csv(path).columns)
    cells = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, line]])
    scan = plain.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", line).option("columnPruning", False)
    parsed = scan.schema(cells).csv(path).select(F.monotonically_increasing_id().alias("row_id"), "*")
    stored = materialise(parsed, "lines")
    fine = null_tokens_to_null(stored.where(F.col(f"`{line}`").isNull()).drop(line))
    return rename(fine, names), rename(stored.where(F.col(f"`{line}`").isNotNull()), names)


def write_csv(df: DataFrame, path: str, names: Mapping[str, str] = CANONICAL_TO_RAW, mode: str = "error") -> None:
    """Header CSV with the raw names; list columns are written as JSON text."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    flat = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])
    rename(flat, names).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def complete_schema(df: DataFrame, expected: Iterable[str], dtype: str = "string") -> DataFrame:
    """Add absent expected columns as NULL; extra columns stay."""
    absent = [c for c in expected if c not in df.columns]
    return df.select("*", *[F.lit(None).cast(dtype).alias(c) for c in absent]) if absent else df


def ensure_survey_schema(df: DataFrame, spec: CleanSpec = SURVEY) -> DataFrame:
    return complete_schema(df, spec.expected)


def is_cleaned(df: DataFrame, spec: CleanSpec = SURVEY) -> bool:
    """A table that already has the label column counts as cleaned."""
    return spec.label_col in df.columns


def typed_cleaned(df: DataFrame, spec: CleanSpec = SURVEY) -> DataFrame:
    """Types of a cleaned table that was read from text."""
    casts = {c: "long" for c in spec.discretes} | {spec.money: "double", spec.label_col: "int"}
    return df.select(
        *[F.col(c).try_cast("double").cast(casts[c]).alias(c) if c in casts else F.col(f"`{c}`") for c in df.columns]
    )


def read_cleaned(spark: SparkSession, path: str, spec: CleanSpec = SURVEY) -> DataFrame:
    """A cleaned table, from Parquet or from a header CSV."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return typed_cleaned(read_csv(spark, path), spec)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(header, files) of the CSV files below a folder: the first line of each, files of equal headers together.

    Only the first split of a file is looked at; its first line has the smallest row number there.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"),
    )
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"))
    return first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files"))
