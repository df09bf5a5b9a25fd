"""Statistics of the corpus and its schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.functions.text import keyword_flags


def corpus_counts(examples: DataFrame) -> DataFrame:
    """Rows of both splits and databases over all.

    Databases are counted after a distinct with map-side combine; each task sends a database once.
    """
    per_database = examples.groupBy("db_id").agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "validation").alias("validation"),
    )
    return per_database.agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("num_train"),
        F.coalesce(F.sum("validation"), F.lit(0)).alias("num_val"),
        F.count("db_id").alias("num_databases"),
    )


def length_stats(examples: DataFrame) -> DataFrame:
    return examples.agg(
        F.avg(F.length(F.coalesce("query", F.lit("")))).alias("avg_query_length"),
        F.avg(F.length(F.coalesce("question", F.lit("")))).alias("avg_question_length"),
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins between least and greatest value, empty ones included; the last bin is closed.

    Equal values are counted first: for lengths and table counts that leaves a table far smaller than the
    input, which the bounds and the bins are both taken from. When all values are equal the range is
    widened by a half on each side.
    """
    values = df.select(value.cast("double").alias("x")).filter("x IS NOT NULL").groupBy("x").agg(
        F.count("*").alias("n")
    )
    ends = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    pad = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    bounds = ends.select(F.struct((F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))).scalar()

    def edge(i: Column) -> Column:
        lo, hi = F.col("b.lo"), F.col("b.hi")
        return F.when(i == bins, hi).otherwise(i * ((hi - lo) / F.lit(bins)) + lo)

    span = F.col("b.hi") - F.col("b.lo")
    guess = F.least(F.floor((F.col("x") - F.col("b.lo")) / span * F.lit(bins)).cast("int"), F.lit(bins - 1))
    placed = values.withColumn("b", bounds).withColumn("g", guess)
    # rounding can put a value that lies on an edge one bin off
    bin_no = (
        F.when(F.col("x") < edge(F.col("g")), F.col("g") - 1)
        .when((F.col("x") >= edge(F.col("g") + 1)) & (F.col("g") != bins - 1), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    counts = placed.groupBy(bin_no.alias("bin")).agg(F.sum("n").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(counts, "bin", "left")
        .withColumn("b", bounds)
        .select(
            "bin",
            edge(F.col("bin")).alias("bin_start"),
            edge(F.col("bin") + 1).alias("bin_end"),
            F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        )
    )


def keyword_distribution(examples: DataFrame) -> DataFrame:
    """Queries holding each keyword, most frequent first."""
    return (
        examples.select(F.explode(keyword_flags(F.col("query"))).alias("keyword"))
        .groupBy("keyword")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "keyword")
    )


def schema_size_stats(sizes: DataFrame) -> DataFrame:
    """Mean tables and columns per database."""
    return sizes.agg(F.avg("n_tables").alias("avg_tables"), F.avg("n_columns").alias("avg_columns"))
