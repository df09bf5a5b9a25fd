"""The four stages: corpus files to prompts, and raw outputs to an augmented training table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sqlgauge.operators import accuracy, augmentation, error_tables, prompts, sampling, significance, taxonomy
from sqlgauge.operators.execution import score_execution
from sqlgauge.operators.scoring import score_exact
from sqlgauge.session import written
from sqlgauge.settings import Settings
from sqlgauge.sources import corpus
from sqlgauge.sources.databases import Databases


@dataclass(frozen=True)
class Prepared:
    ddl: DataFrame
    train: DataFrame
    evaluation: DataFrame
    prompts: DataFrame
    questions: DataFrame
    counts: dict[str, int]


@dataclass(frozen=True)
class Evaluation:
    scored: DataFrame
    overall: DataFrame
    by_difficulty: DataFrame
    by_database: DataFrame
    summary: DataFrame
    levels: DataFrame
    running: DataFrame
    report: DataFrame
    paired_tests: DataFrame


@dataclass(frozen=True)
class Analysis:
    classified: DataFrame
    profile: DataFrame
    summary: DataFrame
    categories: DataFrame
    primary: DataFrame
    matrix: DataFrame
    weaknesses: DataFrame
    shifts: DataFrame | None


@dataclass(frozen=True)
class Augmentation:
    weak: DataFrame
    rows: DataFrame
    stats: DataFrame
    totals: DataFrame
    mix: DataFrame


def prepare(spark: SparkSession, path: str, catalog: DataFrame, settings: Settings = Settings()) -> Prepared:
    """Loads a corpus with its nested schema catalog, cuts a validation split where it has none, and builds schema texts and prompts.

    ``prompts`` are the training rows within the length limit, ``questions`` the prompts that a model is asked to
    continue, over the validation rows. Examples and schema texts are written once; both prompt tables read them. The
    training prompts are written in the pass that counts them: ``counts`` has ``examples``, ``kept`` and ``dropped``.
    """
    loaded = corpus.load_examples(spark, path)
    shown = settings.prompts
    ddl = written(prompts.schema_ddl(catalog, shown.with_types, shown.with_foreign_keys), "ddl")
    plain = loaded.select("idx", "split", "db_id", "question", "query")
    marked = written(sampling.split_examples(plain, settings.validation_ratio, settings.split_seed), "examples")
    chosen = sampling.subset(marked, {"train": settings.train_subset, "validation": settings.eval_subset})
    train = chosen.filter(F.col("split") == "train")
    evaluation = chosen.filter(F.col("split") == "validation")
    counts = Observation("training prompts")
    kept = written(prompts.prepare_training_data(train, ddl, shown, counts), "prompts")
    return Prepared(
        ddl=ddl,
        train=train,
        evaluation=evaluation,
        prompts=kept,
        questions=prompts.inference_prompts(evaluation, ddl, shown),
        counts=counts.get,
    )


def evaluate(
    predictions: DataFrame, databases: Databases | None = None, settings: Settings = Settings()
) -> Evaluation:
    """Scores every prediction and prepares the accuracy tables.

    The scored table is written once: its many aggregates then read a few columns of it instead of
    cleaning and scoring the texts again.
    """
    scored = score_exact(predictions) if databases is None else score_execution(
        predictions, databases, timeout=settings.statement_timeout
    )
    scored = written(scored, "scored")
    overall = accuracy.accuracy_overall(scored)
    intervals = significance.bootstrap_ci(scored, settings.bootstrap)
    return Evaluation(
        scored=scored,
        overall=overall,
        by_difficulty=accuracy.accuracy_by_difficulty(scored),
        by_database=accuracy.accuracy_by_database(scored),
        summary=significance.model_summary(scored, settings.bootstrap),
        levels=significance.difficulty_summary(scored, settings.bootstrap),
        running=accuracy.running_accuracy(scored, settings.running_every),
        report=accuracy.accuracy_pivot(scored, intervals),
        paired_tests=significance.mcnemar_test(significance.mcnemar_table(scored), overall),
    )


def analyze(
    scored: DataFrame, columns: DataFrame | None = None, shifts: Sequence[tuple[str, str]] = ()
) -> Analysis:
    """Classifies the wrong predictions and prepares the error tables.

    The classified table is written once; every error table follows from its small profile.
    """
    classified = written(taxonomy.classify_errors(scored, columns, keep_correct=True), "classified")
    profile = written(error_tables.error_profile(classified), "profile")
    categories = error_tables.category_distribution(profile)
    return Analysis(
        classified=classified.filter(F.col("categories").isNotNull()),
        profile=profile,
        summary=error_tables.error_summary(profile),
        categories=categories,
        primary=error_tables.primary_distribution(profile),
        matrix=error_tables.matrix_row_percent(error_tables.difficulty_error_matrix(profile)),
        weaknesses=error_tables.ranked_weaknesses(categories),
        shifts=error_tables.distribution_shift(profile, shifts) if shifts else None,
    )


def augment(
    analysis: Analysis, model: str, train: DataFrame, ddl: DataFrame, settings: Settings = Settings()
) -> Augmentation:
    """Builds the training table of the next round from one model's errors.

    The small tables that steer it are written first: each is measured and joined more than once.
    """
    chosen = settings.augmentation
    ddl = written(ddl, "ddl")
    errors = analysis.classified.filter(F.col("model_name") == model)
    weak = augmentation.weak_categories(
        analysis.weaknesses.filter(F.col("model_name") == model), chosen.top_k, chosen.threshold
    )
    weak = written(weak, "weak")
    databases = written(augmentation.error_databases(errors, weak), "error-databases")
    related = augmentation.related_examples(train, databases)
    shown = augmentation.error_sources(augmentation.error_examples(errors, weak), chosen.gold_as_query)
    sources = related.select(*shown.columns).unionByName(shown)
    made = augmentation.augment(augmentation.related_by_category(train, databases), chosen)
    rows = written(made.unionByName(augmentation.augment(shown, chosen)), "rewrites")
    original = prompts.prepare_training_data(train, ddl, settings.prompts)
    place = augmentation.training_mix(original, rows, chosen.seed)
    return Augmentation(
        weak=weak,
        rows=rows,
        stats=augmentation.augmentation_stats(sources, rows),
        totals=augmentation.augmentation_totals(train, rows),
        mix=augmentation.mixed_prompts(place, ddl, settings.prompts),
    )
