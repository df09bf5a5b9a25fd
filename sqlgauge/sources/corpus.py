"""Corpus files and schema catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge.schemas import CORPUS_FILE

# Split names in loading order; any other comes after them, by name.
SPLITS = ("train", "validation")

_SHARD_BITS = 40
#: Rows with nested schemas that one partition of a join holds.
CATALOG_ROWS = 1 << 16
_RANK_BITS = 58


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """All splits of a corpus.

    The split is the start of a file's name (``train-00000-of-00002.parquet``) or, for part files, of their folder's
    (``test.parquet/part-00000-....parquet``). ``idx`` is the row's position in its split: the shard number
    in the high bits, the row number inside the file in the low ones. It is dense for a one-file split and
    in file order for any other, without a shuffle to number the rows. A position is unique with its split only.
    """
    files = spark.read.schema(CORPUS_FILE).parquet(path)
    steps = F.split(F.col("_metadata.file_path"), "/")
    file, folder = F.element_at(steps, -1), F.element_at(steps, -2)
    name = F.when(F.startswith(file, F.lit("part-")), folder).otherwise(file)
    shard = F.when(name == file, F.regexp_extract(file, r"^[^-]+-(\d+)-", 1)).otherwise(F.regexp_extract(file, r"^part-(\d+)", 1))
    shard = F.when(shard == "", F.lit(0)).otherwise(shard.try_cast("long"))
    idx = F.shiftleft(shard, _SHARD_BITS) + F.col("_metadata.row_index")
    split = F.regexp_extract(name, r"^([^-.]+)", 1)
    return files.select(idx.alias("idx"), split.alias("split"), *CORPUS_FILE.fieldNames())


def split_rank(splits: Sequence[str] = SPLITS) -> Column:
    """The place of a split in loading order; unknown ones share the last place."""
    rank = F.lit(len(splits))
    for position, name in enumerate(splits):
        rank = F.when(F.col("split") == name, F.lit(position)).otherwise(rank)
    return rank


def schema_catalog(examples: DataFrame, rows: int = CATALOG_ROWS) -> DataFrame:
    """The first schema seen for each database, over the splits in order.

    Positions alone are aggregated, by hash; the nested schema columns are read for the rows that come first. Nested columns
    repeat themselves, so their compressed size says little of what a task has to hold: the rows are dealt by number, about
    ``rows`` to a partition, by database and position, so that no database gathers in one of them.
    """
    nested = ("table_names", "columns", "column_types", "foreign_keys", "primary_keys")
    place = F.shiftleft(split_rank().cast("long"), _RANK_BITS) + F.col("idx")
    # a name that is never null, so that the join and the window keep the partitions
    key = F.coalesce(F.concat(F.lit("="), "db_id"), F.lit(""))
    placed = examples.select("db_id", "split", *nested, key.alias("_key"), place.alias("_place"))
    first = placed.groupBy("_key").agg(F.min("_place").alias("_place"))
    usual = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, -(-examples.count() // rows))
    found = placed.repartition(parts, "_key", "_place").join(first.repartition(parts, "_key", "_place"), ["_key", "_place"])
    # splits of equal rank may share a position
    at = F.row_number().over(Window.partitionBy("_key", "_place").orderBy("split"))
    return found.withColumn("_at", at).filter(F.col("_at") == 1).select("db_id", *nested)


def catalog_long(catalog: DataFrame) -> DataFrame:
    """One row per column of a nested catalog, wildcards left out, with the foreign keys that start there.

    A key is kept only when both ends are columns of a table. Narrow: one row explodes into its columns.
    """
    placed = F.filter(
        F.transform(
            F.coalesce("foreign_keys", F.array().cast("array<struct<col:int,ref_col:int>>")),
            lambda k, i: F.struct(
                i.alias("fk_pos"),
                k["col"].alias("col_idx"),
                F.get(F.col("columns"), k["col"])["table_idx"].alias("from_table"),
                F.get(F.col("columns"), k["ref_col"]).alias("target"),
            ),
        ),
        lambda k: (k["from_table"] >= 0) & (k["target"]["table_idx"] >= 0),
    )
    fks = F.transform(
        F.filter("_fks", lambda k: k["col_idx"] == F.col("col_idx")),
        lambda k: F.struct(
            k["fk_pos"].alias("fk_pos"),
            F.get(F.col("table_names"), k["target"]["table_idx"]).alias("ref_table"),
            k["target"]["name"].alias("ref_column"),
        ),
    )
    return (
        catalog.withColumn("_fks", placed)
        .select("*", F.posexplode("columns").alias("col_idx", "_column"))
        .filter("_column.table_idx >= 0")
        .select(
            "db_id",
            F.col("_column.table_idx").alias("table_idx"),
            F.get("table_names", F.col("_column.table_idx")).alias("table_name"),
            "col_idx",
            F.col("_column.name").alias("col_name"),
            F.coalesce(F.get("column_types", F.col("col_idx")), F.lit("")).alias("col_type"),
            F.coalesce(F.array_contains("primary_keys", F.col("col_idx")), F.lit(False)).alias("is_pk"),
            fks.alias("fks"),
        )
    )


def catalog_sizes(catalog: DataFrame) -> DataFrame:
    """Tables and non-wildcard columns of each database of a nested catalog."""
    real = F.filter("columns", lambda c: c["table_idx"] >= 0)
    return catalog.select(
        "db_id",
        F.coalesce(F.size("table_names"), F.lit(0)).cast(T.LongType()).alias("n_tables"),
        F.coalesce(F.size(real), F.lit(0)).cast(T.LongType()).alias("n_columns"),
    )
