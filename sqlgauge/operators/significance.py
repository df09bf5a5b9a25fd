"""Confidence intervals and paired tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.functions.binomial import quantile
from sqlgauge.functions.text import keyed_uniform
from sqlgauge.operators.accuracy import accuracy_by_difficulty, accuracy_overall
from sqlgauge.session import evaluated_once
from sqlgauge.settings import BootstrapSettings

def _ranked_uniforms(df: DataFrame, settings: BootstrapSettings, ranks: Sequence[int]) -> Column:
    """The uniforms of the given ranks among one uniform per replicate, as an uncorrelated subquery."""
    draws = df.sparkSession.range(settings.reps).select(keyed_uniform(settings.seed, F.col("id")).alias("u"))
    ordered = draws.agg(F.sort_array(F.collect_list("u")).alias("us"))
    return ordered.select(F.array(*[F.get("us", F.lit(r)) for r in ranks])).scalar()


def bootstrap_ci(scored: DataFrame, settings: BootstrapSettings = BootstrapSettings()) -> DataFrame:
    """Mean accuracy of each model and the percentile interval of its resampled means.

    Scores are 0 or 1, so the mean of a resample of n scores with k hits is a Binomial(n, k/n) draw over n; one count of
    n and k replaces the resampled rows. A draw is the quantile of a uniform, which keeps order, so the percentiles of
    the draws are the quantiles of the uniforms next to them: four quantiles for each model, whatever n is.
    """
    alpha = (1 - settings.confidence) / 2
    places = [q * (settings.reps - 1) for q in (alpha, 1 - alpha)]
    ranks = [r for place in places for r in (math.floor(place), math.ceil(place))]
    counts = scored.groupBy("model_name").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("k"))
    n, k = F.col("n"), F.col("k")
    uniforms = counts.withColumn("us", _ranked_uniforms(scored, settings, ranks))
    drawn = evaluated_once(uniforms, draws=F.transform("us", lambda u: quantile(u, n, k) / n))

    def percentile(i: int) -> Column:
        below, above = F.get("draws", F.lit(2 * i)), F.get("draws", F.lit(2 * i + 1))
        return below + (above - below) * F.lit(places[i] - math.floor(places[i]))

    return drawn.select("model_name", (k / n).alias("mean"), percentile(0).alias("ci_lower"), percentile(1).alias("ci_upper"))


def model_summary(scored: DataFrame, settings: BootstrapSettings = BootstrapSettings()) -> DataFrame:
    """Accuracy, interval and number of examples of each model; for the levels see ``difficulty_summary``."""
    return (
        accuracy_overall(scored)
        .join(bootstrap_ci(scored, settings), "model_name")
        .select("model_name", "accuracy", "ci_lower", "ci_upper", F.col("total").alias("num_examples"))
    )


def difficulty_summary(scored: DataFrame, settings: BootstrapSettings = BootstrapSettings()) -> DataFrame:
    """The summary of each model with its accuracy at each difficulty: one row per model and level."""
    levels = accuracy_by_difficulty(scored).select("model_name", "difficulty", F.col("accuracy").alias("level_accuracy"), F.col("total").alias("level_total"))
    return model_summary(scored, settings).join(levels, "model_name")


def mcnemar_table(scored: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Paired outcomes of each two models over the positions both have; a pair in alphabetical order, or in the order given.

    One shuffle on the position gathers a position's (model, outcome) list, whose length is the number of models. Equal
    lists are counted first, which is all that is left to do for a few models; the pairs of each list are then
    added up with partial sums, whatever the number of models.
    """
    rank = F.lit(0)
    if models is not None:
        scored = scored.filter(F.col("model_name").isin(list(models)))
        rank = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model_name")).cast("int")
    outcome = F.struct(rank.alias("rank"), F.col("model_name").alias("model"), F.col("is_correct").alias("right"))
    rows = scored.filter(F.col("is_correct").isNotNull()).groupBy("idx").agg(F.array_sort(F.collect_list(outcome)).alias("all"))
    # of several outcomes of one model the last in order counts: the right one
    last = F.filter("all", lambda x, i: F.coalesce(F.get("all", i + 1)["model"] != x["model"], F.lit(True)))
    lists = rows.select(last.alias("list")).groupBy("list").agg(F.count("*").alias("n"))
    firsts = lists.select("list", "n", F.posexplode("list").alias("at", "a"))
    rest = F.slice("list", F.col("at") + 2, F.size("list"))
    pairs = firsts.select("n", "a", F.explode(rest).alias("b"))
    a, b, n = F.col("a.right"), F.col("b.right"), F.col("n")

    def rows_with(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    return pairs.groupBy(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(
        rows_with(a & ~b).alias("b10"),
        rows_with(~a & b).alias("b01"),
        rows_with(a & b).alias("both"),
        rows_with(~a & ~b).alias("neither"),
    )


def chi2_tail(chi2: Column) -> Column:
    """P(X > chi2) for one degree of freedom: 1 - erf(sqrt(chi2 / 2)) by the series of erf."""
    half = chi2 / F.lit(2.0)
    terms = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: half / (i.cast("double") + F.lit(0.5)))
    folded = F.aggregate(
        terms,
        F.struct(F.lit(2.0).alias("term"), F.lit(2.0).alias("total")),
        lambda acc, f: F.struct(
            (acc["term"] * f).alias("term"), (acc["total"] + acc["term"] * f).alias("total")
        ),
        lambda acc: acc["total"],
    )
    erf = F.sqrt(half) * F.exp(-half) / F.sqrt(F.lit(math.pi)) * folded
    return F.when(chi2 > 70, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - erf))


def mcnemar_test(table: DataFrame, accuracies: DataFrame) -> DataFrame:
    """Continuity-corrected test of each pair, with both models' accuracies."""
    discordant = F.col("b01") + F.col("b10")
    gap = (F.abs(F.col("b01") - F.col("b10")) - F.lit(1)).cast("double")
    chi2 = F.when(discordant == 0, 0.0).otherwise(F.try_divide(gap * gap, discordant))
    p_value = F.when(discordant == 0, 1.0).otherwise(chi2_tail(F.col("chi2")))
    tested = table.withColumn("chi2", chi2).withColumn("p_value", p_value)
    for side in ("a", "b"):
        one = accuracies.select(F.col("model_name").alias(f"model_{side}"), F.col("accuracy").alias(f"accuracy_{side}"))
        tested = tested.join(one, f"model_{side}")
    return tested.select(
        "model_a",
        "model_b",
        "accuracy_a",
        "accuracy_b",
        F.col("chi2").alias("mcnemar_chi2"),
        "p_value",
        (F.col("p_value") < 0.05).alias("significant_at_05"),
        (F.col("p_value") < 0.01).alias("significant_at_01"),
    )
