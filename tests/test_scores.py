"""Accuracy, running totals, intervals and paired tests."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import binomial
from sqlgauge.operators import accuracy, running, sampling, scoring, significance
from sqlgauge.settings import BootstrapSettings

SCORED = "model_name string, idx long, is_correct boolean, difficulty string"


def scored(spark, hits, model="m", step=1):
    rows = [(model, i * step, bool(h), None) for i, h in enumerate(hits)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCORED)


def test_score_exact(spark):
    rows = [(1, "SELECT  A;", "```select a```"), (2, "SELECT 'A'", "SELECT 'B'"), (3, None, None), (4, "x", None)]
    found = scoring.score_exact(spark.createDataFrame(rows, "idx long, gold_sql string, raw_output string"))
    assert [(r.idx, r.pred_sql, r.is_correct) for r in found.orderBy("idx").collect()] == [
        (1, "select a", True),
        (2, "SELECT 'B'", False),
        (3, "", True),
        (4, "", False),
    ]


@pytest.mark.parametrize("page_bits", [1, 2, 16])
@pytest.mark.parametrize("step", [1, 7, 1000])
def test_running_totals_over_pages_and_books(spark, page_bits, step):
    amounts = [random.Random(i).randint(-5, 5) for i in range(60)]
    rows = [("k", i * step, a) for i, a in enumerate(amounts)] + [("other", 3, 4)]
    df = spark.createDataFrame(rows, "key string, at long, amount long").repartition(5)
    found = running.running_totals(df, ["key"], "at", {"total": F.col("amount")}, page_bits)
    expected = [("k", i * step, sum(amounts[: i + 1])) for i in range(60)] + [("other", 3, 4)]
    assert sorted((r.key, r["at"], r.total) for r in found.collect()) == expected


def test_running_accuracy(spark):
    hits = [i % 3 == 0 for i in range(130)]
    expected = [(50, 17, 17 / 50), (100, 34, 0.34)]
    for step, dense in ((1, True), (1, False), (13, False)):
        found = accuracy.running_accuracy(scored(spark, hits, step=step), dense=dense).orderBy("examples")
        assert [tuple(r)[1:] for r in found.collect()] == expected


@pytest.mark.parametrize("page_bits", [2, 5, 16])
def test_take_first_on_pages_of_any_size(spark, monkeypatch, page_bits):
    monkeypatch.setattr(sampling, "PAGE_BITS", page_bits)
    df = spark.range(0, 300, 3).withColumnRenamed("id", "idx").repartition(4)
    for n in (1, 40, 99):
        assert sorted(r.idx for r in sampling.take_first(df, n).collect()) == list(range(0, 3 * n, 3))
    assert sampling.take_first(df, None) is df
    assert sampling.take_first(df, 1000).count() == 100


def test_take_first_of_tied_positions_is_repeatable(spark):
    df = spark.range(100).select((F.col("id") / 10).cast("long").alias("idx"), F.col("id").alias("v"))
    a, b = ({r.v for r in sampling.take_first(df.repartition(p), 25).collect()} for p in (1, 9))
    assert a == b and len(a) == 25 and {v // 10 for v in a} == {0, 1, 2}


def test_subset_by_split_and_split_only_where_none_is(spark):
    df = spark.range(300).select(F.col("id").alias("idx"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    found = sampling.subset(df, {"train": 10, "validation": 5}).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in found} == {"train": 10, "test": 100}
    cut = sampling.split_examples(df)
    assert cut.filter("split = 'test'").count() == 100 and cut.filter("split = 'validation'").count() > 0
    again = sampling.split_examples(cut)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, cut.collect()))


def test_pairs_of_many_models(spark):
    models = spark.range(200).select(F.concat(F.lit("m"), F.lpad("id", 4, "0")).alias("model_name"), F.col("id").alias("m"))
    rows = models.crossJoin(spark.range(5).withColumnRenamed("id", "idx")).withColumn("is_correct", (F.col("m") + F.col("idx")) % 3 == 0)
    found = significance.mcnemar_table(rows)
    assert found.count() == 200 * 199 // 2
    one = found.filter("model_a = 'm0000' and model_b = 'm0001'").first()
    right = [[(m + i) % 3 == 0 for i in range(5)] for m in (0, 1)]
    assert one.b10 == sum(a and not b for a, b in zip(*right)) and one.b01 == sum(b and not a for a, b in zip(*right))


def test_split_is_independent_of_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "idx")
    one = sampling.split_examples(df.repartition(1)).filter("split = 'validation'")
    many = sampling.split_examples(df.repartition(13)).filter("split = 'validation'")
    a, b = ({r.idx for r in d.collect()} for d in (one, many))
    assert a == b and len(a) == 500
    assert a == set(sorted(range(5000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())[:500])


@pytest.mark.parametrize(("n", "ratio"), [(0, 0.1), (1, 0.1), (7, 0.5), (999, 0.1), (999, 0.0), (50, 1.0), (70_001, 0.3)])
def test_split_has_its_exact_size(spark, n, ratio):
    cut = sampling.split_examples(spark.range(n).withColumnRenamed("id", "idx"), ratio)
    found = {r.split: r["count"] for r in cut.groupBy("split").count().collect()}
    held_out = math.ceil(ratio * n)
    assert found == {s: c for s, c in (("validation", held_out), ("train", n - held_out)) if c}


def test_split_of_rows_that_share_a_position(spark):
    rows = [(None, "a")] * 40 + [(1, "b")] * 40 + [(2, str(i)) for i in range(20)]
    df = spark.createDataFrame([(*r, "train") for r in rows] + [(3, "other", "test")] * 5, "idx long, text string, split string")
    for ratio in (0.01, 0.25, 0.5, 0.77, 0.99):
        cut = sampling.split_examples(df, ratio)
        found = {r.split: r["count"] for r in cut.groupBy("split").count().collect()}
        assert found == {"validation": math.ceil(ratio * 100), "train": 100 - math.ceil(ratio * 100), "test": 5}
        assert sorted(map(str, cut.drop("split").collect())) == sorted(map(str, df.drop("split").collect()))


def test_a_place_is_found_in_few_passes(spark):
    place = F.lpad(F.lower(F.conv(F.col("id").cast("string"), 10, 16)), sampling.PLACE_DIGITS, "0")
    known, rows, wanted = sampling._last_place(spark.range(300_000), place, 123_456)
    assert (known, rows, wanted) == (f"{123_455:048x}", 1, 1)


def exact_quantile(n, p, u):
    total, weight = 0.0, None
    for k in range(n + 1):
        total += math.exp(
            math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
        )
        if total >= u:
            return k
    return n


@pytest.mark.parametrize(("n", "k"), [(10, 3), (1034, 700), (5000, 4990), (40_000, 20_000)])
def test_bootstrap_near_exact_quantiles(spark, n, k):
    found = significance.bootstrap_ci(scored(spark, [i < k for i in range(n)])).first()
    assert found["mean"] == k / n
    slack = 0.12 * math.sqrt(n * (k / n) * (1 - k / n)) + 1
    for name, u in (("ci_lower", 0.025), ("ci_upper", 0.975)):
        assert abs(found[name] * n - exact_quantile(n, k / n, u)) <= slack


def exact_quantiles(n, k, us):
    """By the weights of all points that matter, in extended precision."""
    reach = int(12 * math.sqrt(k * (n - k) / n) + 12)
    j = np.arange(max(0, k - reach), min(n, k + reach) + 1).astype(np.longdouble)
    steps = np.log((n - j[1:] + 1) / j[1:] * k / (n - k))
    logs = np.concatenate([[0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    cdf = np.cumsum(weights) / weights.sum()
    return [float(j[np.searchsorted(cdf, u)]) for u in us]


def test_quantiles_are_exact_for_any_number_of_trials(spark):
    us = [1e-6, 0.025, 0.0251, 0.3, 0.5, 0.975, 0.999999]
    cases = [(2, 1), (10, 3), (1034, 700), (5000, 4990), (40_000, 20_000), (10**7, 9 * 10**6), (10**9, 7 * 10**8), (10**9, 3)]
    df = spark.createDataFrame([(n, k, us) for n, k in cases], "n long, k long, us array<double>")
    found = df.select("n", "k", F.transform("us", lambda u: binomial.quantile(u, F.col("n"), F.col("k"))).alias("q")).collect()
    assert {(r.n, r.k): r.q for r in found} == {(n, k): exact_quantiles(n, k, us) for n, k in cases}


def test_intervals_need_no_window(spark):
    plan = significance.bootstrap_ci(scored(spark, [1, 0, 1]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate posexplode" not in plan


def test_bootstrap_of_constant_scores(spark):
    both = scored(spark, [1] * 7, "all").unionAll(scored(spark, [0] * 5, "none"))
    found = {r.model_name: tuple(r)[1:] for r in significance.bootstrap_ci(both).collect()}
    assert found == {"all": (1.0, 1.0, 1.0), "none": (0.0, 0.0, 0.0)}


def test_bootstrap_follows_its_parameters(spark):
    rows = scored(spark, [i % 2 for i in range(400)])
    wide = significance.bootstrap_ci(rows, BootstrapSettings(reps=2000, confidence=0.99)).first()
    narrow = significance.bootstrap_ci(rows, BootstrapSettings(reps=2000, confidence=0.5)).first()
    assert wide["ci_lower"] < narrow["ci_lower"] < 0.5 < narrow["ci_upper"] < wide["ci_upper"]


def test_chi2_tail_against_erfc(spark):
    values = [0.0, 1e-6, 0.1, 0.5, 1.0, 3.84, 6.63, 15.0, 30.0, 69.9, 70.1, 500.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for value, p in df.select("v", significance.chi2_tail(F.col("v"))).collect():
        assert abs(p - math.erfc(math.sqrt(value / 2))) < 1e-13


def paired(spark, a, b):
    return scored(spark, a, "a").unionAll(scored(spark, b, "b"))


def mcnemar(rows):
    return significance.mcnemar_test(significance.mcnemar_table(rows), accuracy.accuracy_overall(rows)).first()


def test_mcnemar(spark):
    found = mcnemar(paired(spark, [1] * 30 + [0] * 10 + [1] * 5, [1] * 20 + [0] * 10 + [1] * 10 + [1] * 5))
    assert found["mcnemar_chi2"] == (abs(10 - 10) - 1) ** 2 / 20
    found = mcnemar(paired(spark, [1] * 30, [1] * 10 + [0] * 20))
    assert found["mcnemar_chi2"] == 19**2 / 20 and found["significant_at_01"]
    assert (found["accuracy_a"], found["accuracy_b"]) == (1.0, 10 / 30)


def test_mcnemar_without_discordant_rows(spark):
    found = mcnemar(paired(spark, [1, 0, 1], [1, 0, 1]))
    assert (found["mcnemar_chi2"], found["p_value"], found["significant_at_05"]) == (0.0, 1.0, False)
    found = mcnemar(paired(spark, [1, 0, 1], [1, 0, 0]))
    assert (found["mcnemar_chi2"], found["p_value"]) == (0.0, 1.0)


def test_longer_run_is_cut(spark):
    found = significance.mcnemar_table(paired(spark, [1] * 9, [0] * 4)).first()
    assert (found["b10"], found["b01"], found["both"], found["neither"]) == (4, 0, 0, 0)


def test_pairs_of_three_models_follow_the_given_order(spark):
    rows = scored(spark, [1, 0], "x").unionAll(scored(spark, [0, 0], "y")).unionAll(scored(spark, [1, 1], "z"))
    found = significance.mcnemar_table(rows, ["z", "x", "y"]).collect()
    assert {(r.model_a, r.model_b): (r.b10, r.b01) for r in found} == {
        ("z", "x"): (1, 0),
        ("z", "y"): (2, 0),
        ("x", "y"): (1, 0),
    }


def test_pivot_and_grid_fill_missing_levels(spark):
    rows = spark.createDataFrame(
        [("m", 0, True, "easy"), ("m", 1, False, "easy"), ("m", 2, True, None)], SCORED
    )
    wide = accuracy.accuracy_pivot(rows).first()
    assert (wide["overall"], wide["easy"], wide["medium"], wide["extra"]) == (2 / 3, 0.5, 0.0, 0.0)
    grid = {r.difficulty: r.accuracy for r in accuracy.accuracy_grid(rows).collect()}
    assert grid == {"easy": 0.5, "medium": 0.0, "hard": 0.0, "extra": 0.0, "unknown": 1.0}
