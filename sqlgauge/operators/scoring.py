"""Scoring of predictions by text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge.functions.text import extract_sql, normalize_sql
from sqlgauge.session import evaluated_once


def clean_predictions(predictions: DataFrame) -> DataFrame:
    """Adds the SQL text found in each raw output."""
    return predictions.withColumn("pred_sql", extract_sql(F.col("raw_output"))).drop("raw_output")


def score_exact(predictions: DataFrame) -> DataFrame:
    """Adds whether predicted and gold SQL are the same text after normalization."""
    if "pred_sql" not in predictions.columns:
        predictions = clean_predictions(predictions)
    same = normalize_sql(F.col("pred_sql")) == normalize_sql(F.col("gold_sql"))
    return evaluated_once(predictions, is_correct=same)


def exact_details(predictions: DataFrame) -> DataFrame:
    """Adds the record of a text comparison: its method and both normalized texts."""
    return predictions.withColumn(
        "details",
        F.struct(
            F.lit("string_match").alias("method"),
            normalize_sql(F.col("pred_sql")).alias("norm_pred"),
            normalize_sql(F.col("gold_sql")).alias("norm_gold"),
        ),
    )
