"""Accuracy of scored predictions by model, difficulty, database and position.

Every breakdown is a count per group with partial aggregation before its shuffle, so a model, difficulty
or database holding most rows still sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.operators.running import running_totals

# Difficulty levels shown in reports.
DIFFICULTIES = ("easy", "medium", "hard", "extra")


def difficulty() -> Column:
    return F.coalesce("difficulty", F.lit("unknown"))


def _accuracy(scored: DataFrame, *keys: Column | str) -> DataFrame:
    counts = scored.groupBy(*keys).agg(
        F.count_if("is_correct").alias("correct"), F.count("*").alias("total")
    )
    return counts.withColumn("accuracy", F.col("correct") / F.col("total"))


def accuracy_overall(scored: DataFrame) -> DataFrame:
    return _accuracy(scored, "model_name")


def accuracy_by_difficulty(scored: DataFrame) -> DataFrame:
    return _accuracy(scored, "model_name", difficulty().alias("difficulty"))


def accuracy_by_database(scored: DataFrame) -> DataFrame:
    return _accuracy(scored, "model_name", "db_id")


def running_accuracy(scored: DataFrame, every: int = 50, dense: bool = False) -> DataFrame:
    """Accuracy over the first 50, 100, ... rows of each model, in position order.

    With ``dense`` positions (0, 1, 2, ...) rows are first counted into blocks of ``every``, so only block
    counts are shuffled. Otherwise each row is ranked within its model.
    """
    hit = F.when(F.col("is_correct"), 1).otherwise(0)
    if dense:
        block = F.floor(F.col("idx") / F.lit(every)).cast("long")
        blocks = scored.groupBy("model_name", block.alias("block")).agg(
            F.count("*").alias("n"), F.sum(hit).alias("hits")
        )
        totals = running_totals(
            blocks, ["model_name"], "block", {"examples": F.col("n"), "correct": F.col("hits")}
        ).filter(F.col("n") == every)
    else:
        totals = running_totals(
            scored.select("model_name", "idx", "is_correct"),
            ["model_name"],
            "idx",
            {"examples": F.lit(1), "correct": hit},
        ).filter(F.col("examples") % every == 0)
    return totals.select(
        "model_name", "examples", "correct", (F.col("correct") / F.col("examples")).alias("accuracy")
    )


def accuracy_grid(scored: DataFrame, difficulties: Sequence[str] = (*DIFFICULTIES, "unknown")) -> DataFrame:
    """Accuracy of every model at every difficulty, 0 where a model has no row: (model_name, difficulty, accuracy)."""
    cells = F.array(
        *[
            F.struct(
                F.lit(d).alias("difficulty"),
                F.coalesce(F.try_divide(F.col(f"hit_{d}"), F.col(f"all_{d}")), F.lit(0.0)).alias("accuracy"),
            )
            for d in difficulties
        ]
    )
    return _counts_by_level(scored, difficulties).select("model_name", F.inline(cells))


def _counts_by_level(scored: DataFrame, difficulties: Sequence[str]) -> DataFrame:
    level = difficulty()
    return scored.groupBy("model_name").agg(
        F.count("*").alias("total"),
        F.count_if("is_correct").alias("correct"),
        *[F.count_if(level == d).alias(f"all_{d}") for d in difficulties],
        *[F.count_if((level == d) & F.col("is_correct")).alias(f"hit_{d}") for d in difficulties],
    )


def accuracy_pivot(scored: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """One row per model: overall accuracy, interval and the accuracy at each difficulty, 0 where missing."""
    wide = _counts_by_level(scored, DIFFICULTIES).select(
        "model_name",
        (F.col("correct") / F.col("total")).alias("overall"),
        *[
            F.coalesce(F.try_divide(F.col(f"hit_{d}"), F.col(f"all_{d}")), F.lit(0.0)).alias(d)
            for d in DIFFICULTIES
        ],
    )
    if intervals is None:
        return wide
    bounds = intervals.select("model_name", "ci_lower", "ci_upper")
    return wide.join(bounds, "model_name", "left").fillna(0.0, ["ci_lower", "ci_upper"])
