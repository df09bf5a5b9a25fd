"""Shared folders, written tables and byte files that every executor can reach."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = "spark.sql.files.minPartitionNum"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of texts that a task hands to Python at once; a longer text goes alone.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one inside the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/work"
    return qualified(spark, folder)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, in the form that both Spark and pyarrow read."""
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    full = name.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(name).toString().rstrip("/")
    return "file:///" + full.removeprefix("file:").lstrip("/") if full.startswith("file:") else full


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once, where nothing says that they can import it as the driver does."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.master.split("[")[0] == "local":
        known.add(os.getcwd())
    if str(package.parent) in known or getattr(context, "_sent_package", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as files:
        for path in sorted(package.rglob("*.py")):
            files.write(path, path.relative_to(package.parent))
    uri = f"{new_path(spark, 'code')}/{package.name}.zip"
    put_file(uri, [packed.getvalue()])
    context.addPyFile(uri)
    context._sent_package = True


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy", batch_bytes: int | None = None) -> DataFrame:
    """The same rows read back from a new table in the shared folder: cuts lineage and survives lost executors.

    The table stays until whoever set the shared folder clears it. With ``batch_bytes`` a task hands Python at most so much at
    once; else Spark hands over 10,000 rows or 64 MB, which the JVM and the worker of each core hold, besides the vectors that
    grow to take them.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(ARROW_BYTES, None)
    if batch_bytes:
        conf.set(ARROW_BYTES, str(batch_bytes))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if batch_bytes and before is None:
            conf.unset(ARROW_BYTES)
        elif batch_bytes:
            conf.set(ARROW_BYTES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a number to each row, the same on every reading of a stored table in a session.

    Where SPLITS is unset Spark cuts a scan by the cores alive at the time, and a number would mean another row after
    an executor is lost; so it is set here, once.
    """
    spark = df.sparkSession
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty."""
    return df.select(df["doc_id"].cast("long").alias("doc_id"), F.coalesce(df["text"], F.lit("")).alias("text"))


def without(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The numbered rows whose number isn't in ``dropped`` (one column, named like ``row``), without the number."""
    return docs.join(dropped, row, "left_anti").drop(row)


def smallest(id_column: str, row: str) -> Column:
    """Orders rows by id, null ids last, then by row number."""
    return F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), F.col(row).alias("row"))


def file_system(uri: str):
    """pyarrow's file system of a URI, and the path in it. Runs in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, parts: Iterable[bytes]) -> int:
    """Writes a file under a name of its own and moves it in place, so a repeated task leaves one whole file."""
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    size = 0
    with store.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    store.move(attempt, path)
    return size
