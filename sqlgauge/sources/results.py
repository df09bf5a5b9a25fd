"""Saved results: evaluation, comparison, analysis, shift and augmentation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_result(df: DataFrame, path: str, fmt: str = "json", by_model: bool = True) -> None:
    """Writes a result table, one folder per model when it has one.

    A saved model is replaced; models that the table doesn't hold stay as they are, so several are saved under one
    path by one call each. A table without models replaces what is at the path.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    if by_model and "model_name" in df.columns:
        writer = writer.partitionBy("model_name").option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def read_analysis(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Reads a saved result back with its schema; nothing is inferred."""
    return spark.read.schema(schema).format(fmt).load(path).select(*schema.fieldNames())
