"""Documents to training sequences: toxic documents, copies, near copies and contaminated documents go, the rest is packed.

Each stage reads all rows that the one before it kept. Rows stay whole and keep all columns of documents until the
last stage, which returns a row for each piece of a packed sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sqlgauge.llm import contamination, digest_runs, packing, simhash, toxicity, work

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_runs.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).places.drop("piece")


def _shipped(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        work.ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _shipped(drop_toxic)),
    ("exact_dedup", _shipped(drop_exact_copies)),
    ("simhash_near_dedup", _shipped(drop_near_copies)),
    ("benchmark_decontamination", _shipped(drop_contaminated)),
    ("packing", _shipped(pack)),
]

#: Trained trees, fingerprints by XXH64 and token ids are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    Null texts count as empty; empty and very long texts, repeated rows and rows without doc_id pass like any other. Further
    columns are kept until packing, whatever their names. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.written(stage(spark, docs, sf_dir), name)
    return docs
