"""Batch scoring of raw tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.scales import label_title
from surveyloom.plans.clean import clean, clean_final
from surveyloom.plans.evaluate import accuracy
from surveyloom.plans.train import with_row_id
from surveyloom.schema import LABEL_TITLES, RAW_TO_CANONICAL, SURVEY, CleanSpec
from surveyloom.sources.tables import null_tokens_to_null, read_csv, read_csv_checked


def score_cleaned(df: DataFrame, model: PipelineModel, titles: Mapping = LABEL_TITLES) -> DataFrame:
    """Prediction and its title for every row of a cleaned table."""
    scored = model.transform(df)
    return scored.withColumn("pred", F.col("prediction").cast("int")).withColumn(
        "pred_name", label_title(F.col("pred"), titles)
    )


def score_raw(raw: DataFrame, model: PipelineModel, titles: Mapping = LABEL_TITLES, **clean_args) -> DataFrame:
    """Clean without dropping a row, then score; ``row_id`` tells the input order."""
    cleaned = clean_final(with_row_id(raw), drop_sparse=False, **clean_args).df
    return score_cleaned(cleaned, model, titles)


def predict_file(spark: SparkSession, path: str, model: PipelineModel, titles: Mapping = LABEL_TITLES) -> DataFrame:
    """One title per row of a raw CSV, with the row id that restores the file order."""
    return score_raw(read_csv(spark, path), model, titles).select("row_id", "pred", "pred_name")


def predict_records(spark: SparkSession, records, model: PipelineModel, titles: Mapping = LABEL_TITLES) -> DataFrame:
    """Titles for single raw records, each filled by the defaults as if it came alone."""

    def text(v):
        return None if v is None else str(v)

    rows = [
        (i, *[text(r.get(raw)) for raw in RAW_TO_CANONICAL]) for i, r in enumerate(records)
    ]
    schema = "row_id long, " + ", ".join(f"{c} string" for c in RAW_TO_CANONICAL.values())
    raw = null_tokens_to_null(spark.createDataFrame(rows, schema))
    return score_raw(raw, model, titles, fill="default").select("row_id", "pred", "pred_name")


def evaluate_file(spark: SparkSession, path: str, model: PipelineModel, titles: Mapping = LABEL_TITLES) -> dict:
    """Accuracy on a raw CSV with known classes; rows of unknown class are counted, not scored."""
    raw = read_csv(spark, path)
    scored = score_raw(raw, model, titles).withColumn("true_name", label_title(F.col("label"), titles))
    known = F.col("label").isNotNull()
    row = scored.agg(
        F.count("*").alias("rows"),
        F.count_if(~known).alias("unknown"),
        accuracy("pred", "label").alias("accuracy"),
    ).first()
    if row["rows"] == 0:
        raise ValueError("no rows to evaluate")
    return {
        "accuracy": row["accuracy"],
        "rows_raw": row["rows"],
        "rows_after_cleaning": row["rows"],
        "rows_dropped_by_cleaning": 0,
        "rows_without_label": row["unknown"],
        "pred_df": scored.select("row_id", "label", "true_name", "pred", "pred_name"),
    }


def file_report(
    spark: SparkSession, path: str, model: PipelineModel, titles: Mapping = LABEL_TITLES, spec: CleanSpec = SURVEY,
    names: Mapping[str, str] = RAW_TO_CANONICAL, drop_unknown: bool = False, **scan,
) -> DataFrame:
    """Every line of a raw CSV that may be damaged, with its title: row_id, the id, state, line, label, true_name, pred, pred_name.

    ``state`` is "scored" for a record of known class, "unknown" for one without a
    class or of one that the survey does not know (it gets a title all the same,
    unless ``drop_unknown`` leaves such records out), and "damaged" for a line that
    is no record, whose text is in ``line`` and which has no title. ``scan`` goes to
    ``read_csv_checked``. Probabilities of the classes, if the model gives them, are in ``probability``.
    """
    records, damaged = read_csv_checked(spark, path, names, **scan)
    cleaned = clean(records, spec, drop_sparse=False, drop_unlabelled=drop_unknown).df
    scored = score_cleaned(cleaned, model, titles)
    known = F.col(spec.label_col).isNotNull()
    scored = scored.select(
        "row_id", spec.id_col, F.when(known, "scored").otherwise("unknown").alias("state"), F.lit(None).cast("string").alias("line"),
        F.col(spec.label_col).alias("label"), label_title(F.col(spec.label_col), titles).alias("true_name"), "pred", "pred_name",
        *[vector_to_array(c).alias(c) for c in ("probability",) if c in scored.columns],
    )
    bad = damaged.select("row_id", spec.id_col, F.lit("damaged").alias("state"), "line")
    return scored.unionByName(bad, allowMissingColumns=True)


def summarise_report(report: DataFrame) -> DataFrame:
    """One row: lines, damaged, unknown, scored and the accuracy over the scored ones (null without any)."""
    count = lambda state: F.count_if(F.col("state") == state).alias(state)
    hit = F.when(F.col("state") == "scored", (F.col("pred") == F.col("label")).cast("double"))
    return report.agg(F.count(F.lit(1)).alias("lines"), count("damaged"), count("unknown"), count("scored"), F.avg(hit).alias("accuracy"))
