"""Record scoring as a stream."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from surveyloom.plans.clean import clean_final
from surveyloom.plans.score import score_cleaned
from surveyloom.schema import LABEL_TITLES
from surveyloom.session import fresh_path


def score_survey_stream(
    raw: DataFrame, model: PipelineModel, fills: Mapping | None = None, titles: Mapping = LABEL_TITLES
) -> DataFrame:
    """Clean and score a stream of raw records.

    Every record is treated by itself: medians of a batch do not exist here,
    so missing numbers take the training values, or the defaults.
    """
    cleaned = clean_final(
        raw, drop_sparse=False, fill="train" if fills else "default", train_fills=fills, staged=False
    ).df
    return score_cleaned(cleaned, model, titles)


def run_available(
    stream: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame] | None = None, path: str | None = None
) -> DataFrame:
    """Run a stateless stream over all input present now; the result is the table it wrote.

    Output and offsets lie in the shared folder, so a restart goes on where
    the last run stopped and no row is written twice.
    """
    spark = stream.sparkSession
    base = path or fresh_path(spark, name)
    out = transform(stream) if transform else stream
    query: StreamingQuery = (
        out.writeStream.format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


def run_batches(
    stream: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame] | None = None, path: str | None = None,
    written: Callable[[int], None] | None = None,
) -> DataFrame:
    """Run a stream over all input present now, one folder of rows for each batch; the result is the table of all.

    A batch that ran but was not noted in the stream's progress (a stop between the
    two) runs again after a restart and replaces its own folder, so no row is lost
    or there twice. ``transform`` sees one batch as an ordinary table and may look
    at all its rows; none of its columns may be named batch_number. ``written`` is
    called after each batch with its number.
    """
    spark = stream.sparkSession
    base = path or fresh_path(spark, name)
    change = transform or (lambda df: df)

    def keep(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{base}/rows/batch_number={number}")
        if written:
            written(number)

    query: StreamingQuery = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = change(spark.createDataFrame([], stream.schema)).schema
    return spark.read.schema(schema).parquet(f"{base}/rows").drop("batch_number")
