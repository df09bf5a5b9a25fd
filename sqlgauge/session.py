"""Cutting lineage, and joins with small tables whose size is checked first."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files, compressed, that a lookup may be broadcast from.
BROADCAST_BYTES = 8 * 1024 * 1024
#: A key is hot if it holds more than this part of the rows, and is then spread over as many partitions.
SALTS = 128
#: Rows of a scan that one task matches patterns in.
TASK_ROWS = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; where it names none, a folder inside the warehouse, shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/work"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """The same rows read back from a table in the shared folder; survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, however often later steps use them.

    Spark copies the expression of a column into every filter it pushes below the projection, so a costly
    pattern match would run once per use. A filter on the output of a generator is not pushed; a generator
    of exactly one row therefore keeps the row count and the single evaluation.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Redistributes the rows of a scan over at least as many tasks as the cluster has cores, of at most about ``rows`` rows.

    A pattern match costs far more than moving its row. Scans are cut by bytes and by the row groups of their files, so a small
    file keeps one core, and a task of a large one gets millions of rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a written table, as the optimizer sees them. Starts no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that each hold more than one part in SALTS of the rows: fewer than SALTS, with ``_hot`` true."""
    least = df.count() // SALTS
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > F.lit(max(1, least)))
    return written(counts.select(*keys, F.lit(True).alias("_hot")), "hot")


def lookup_join(
    df: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    spread: Column,
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    stored: bool = False,
) -> DataFrame:
    """Joins each row with the rows of ``small`` on the key.

    ``small`` is written once, unless it is ``stored``, and broadcast if its files are within the bound. Beyond that the join shuffles; keys that
    hold a large share of ``df`` are found by a count and spread over ``SALTS`` partitions, and only their rows of
    ``small`` are copied. ``spread`` is a column that varies within a key, such as the row's position.
    """
    keys = [on] if isinstance(on, str) else list(on)
    small = small if stored else written(small, "lookup")
    if file_bytes(small) <= max_bytes:
        return df.join(F.broadcast(small), keys, how)
    hot = F.broadcast(hot_keys(df, keys))
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    # keys with a null match nothing, so they may go anywhere
    lost = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salted = df.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot") | lost, salt).otherwise(0)).drop("_hot")
    all_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = small.join(hot, keys, "left").withColumn("_salt", F.explode(all_salts)).drop("_hot")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
