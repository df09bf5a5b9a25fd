"""Training rows aimed at the weakest error categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlgauge.functions import rewrites
from sqlgauge.functions.text import keyed_uniform
from sqlgauge.operators.prompts import attach_ddl, format_prompt, with_prompts
from sqlgauge.session import BROADCAST_BYTES, evaluated_once, file_bytes, lookup_join, written
from sqlgauge.settings import AugmentationSettings, PromptSettings


def weak_categories(ranked: DataFrame, k: int = 3, threshold: float = 15.0) -> DataFrame:
    """Per model the k worst categories at or above the threshold; the k worst of all when none reaches it.

    ``ranked`` holds six rows per model, which bounds the window.
    """
    model = Window.partitionBy("model_name")
    passed = F.col("error_rate") >= F.lit(threshold)
    place = F.row_number().over(model.orderBy(F.desc("_passed"), "rank"))
    return (
        ranked.withColumn("_passed", passed.cast("int"))
        .withColumn("_any", F.max("_passed").over(model))
        .withColumn("_place", place)
        .filter((F.col("_place") <= k) & ((F.col("_passed") == 1) | (F.col("_any") == 0)))
        .select("model_name", "category", "error_rate", "rank")
    )


def error_examples(classified: DataFrame, weak: DataFrame) -> DataFrame:
    """Each error once per weak category of its model that it shows: (model_name, category, error columns).

    The weak categories are at most six rows per model; they are broadcast behind a size check.
    """
    shown = classified.select("*", F.explode("categories").alias("category"))
    targets = weak.select("model_name", "category")
    return lookup_join(shown, targets, ["model_name", "category"], spread=F.col("idx"), how="inner")


def error_databases(classified: DataFrame, weak: DataFrame) -> DataFrame:
    """The weak categories each database shows, per model: (model_name, db_id, weak).

    One aggregate over the errors with partial sums: six flags per model and database, no row per category.
    """
    names = list(dict.fromkeys([r.category for r in rewrites.RULES] + ["E6_SYNTAX_FORMAT"]))
    flags = {n: F.bool_or(F.array_contains("categories", n)) for n in names}
    seen = classified.groupBy("model_name", "db_id").agg(*[f.alias(n) for n, f in flags.items()])
    wanted = weak.groupBy("model_name").agg(F.collect_set("category").alias("_wanted"))
    shown = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return (
        seen.join(wanted, "model_name")
        .select("model_name", "db_id", F.array_intersect(shown, "_wanted").alias("weak"))
        .filter(F.size("weak") > 0)
    )


def related_by_category(train: DataFrame, databases: DataFrame) -> DataFrame:
    """Training rows whose database has errors of a weak category, once per category, with the models in ``models``.

    ``databases`` comes from ``error_databases``: one row per model and database. It is gathered to one row
    per database, so the join meets each training row once whatever share one database holds.
    """
    targets = databases.select("db_id", F.explode("weak").alias("category"), "model_name")
    per_category = targets.groupBy("db_id", "category").agg(F.collect_list(F.struct("model_name")).alias("models"))
    per_database = per_category.groupBy("db_id").agg(F.collect_list(F.struct("category", "models")).alias("_targets"))
    return (
        lookup_join(train, per_database, "db_id", spread=F.col("idx"), how="inner")
        .select(*[c for c in train.columns], F.inline("_targets"))
    )


def related_examples(train: DataFrame, databases: DataFrame) -> DataFrame:
    """The same rows once per model and category."""
    found = related_by_category(train, databases)
    return found.select(*train.columns, "category", F.inline("models")).select(*train.columns, "model_name", "category")


def _rewritten(seed: int, multiplier: int) -> Column:
    """Array of (type, question, copies) of the rewrites of the row's category.

    A rewrite that draws its wording is made for each copy, any other one once for all copies.
    """
    question, query = F.col("question"), F.col("query")

    def made(rule: rewrites.RewriteRule, draw: Column, copies: list[int]) -> Column:
        return F.struct(
            F.lit(rule.name).alias("augmentation_type"),
            rule.rewrite(question, query, draw).alias("new_question"),
            F.array(*[F.lit(c) for c in copies]).alias("copies"),
        )

    def all_of(rule: rewrites.RewriteRule) -> list[Column]:
        every = list(range(1, multiplier + 1))
        if not rule.uses_draw:
            return [made(rule, F.lit(None).cast("double"), every)]
        return [made(rule, keyed_uniform(seed, F.col("idx"), F.lit(c)), [c]) for c in every]

    by_category: dict[str, list[Column]] = {}
    for rule in rewrites.RULES:
        by_category.setdefault(rule.category, []).extend(all_of(rule))
    found = F.lit(None)
    for category, rows in by_category.items():
        found = F.when(F.col("category") == category, F.array(*rows)).otherwise(found)
    return found


def augment(examples: DataFrame, settings: AugmentationSettings = AugmentationSettings()) -> DataFrame:
    """Every rewrite of each example's category, for each of its copies.

    One narrow pass: rewrites and copies are exploded from arrays, and only the rewrites of the row's own
    category are evaluated. Rows without database, question or query yield nothing. A rewrite doesn't depend on the model, so
    where a row holds its ``models`` (``related_by_category``) it is made once for all of them.
    """
    shared = "models" in examples.columns
    usable = [F.coalesce(c, F.lit("")) != "" for c in ("db_id", "question", "query")]
    kept = [c for c in ("category", "idx", "db_id", "query") if c in examples.columns]
    named = ["model_name"] if shared or "model_name" in examples.columns else []
    carried = [*kept, "models"] if shared else [*named, *kept]
    made = (
        examples.filter(usable[0] & usable[1] & usable[2])
        .select(*carried, F.inline_outer(_rewritten(settings.seed, settings.multiplier)))
        .filter("new_question IS NOT NULL")
    )
    if shared:
        made = made.select("*", F.inline("models"))
    return made.select(
        *named, *kept, "augmentation_type", F.col("new_question").alias("question"), F.explode("copies").alias("copy")
    )


def error_sources(errors: DataFrame, gold_as_query: bool = False) -> DataFrame:
    """Error examples in the shape of training rows; without a query unless the gold SQL is to serve as one."""
    query = F.col("gold_sql") if gold_as_query else F.lit(None).cast("string")
    return errors.select("idx", "db_id", "question", query.alias("query"), "model_name", "category")


def augmentation_stats(sources: DataFrame, augmented: DataFrame) -> DataFrame:
    """Per model and category the source rows and the rows made of them; categories without a rewrite are left out."""
    keys = ["model_name", "category"]
    with_rewrite = sorted({rule.category for rule in rewrites.RULES})
    used = sources.filter(F.col("category").isin(with_rewrite))
    made = augmented.groupBy(*keys).agg(F.count("*").alias("augmented_examples"))
    counted = used.groupBy(*keys).agg(F.count("*").alias("source_examples"))
    return counted.join(made, keys, "left").fillna(0, ["augmented_examples"])


def augmentation_totals(train: DataFrame, augmented: DataFrame) -> DataFrame:
    """Rows of the original table, of each model's rewrites, and of both together."""
    per_model = augmented.groupBy("model_name").agg(F.count("*").alias("total_augmented"))
    original = train.agg(F.count("*").alias("n")).scalar()
    return per_model.select(
        "model_name", original.alias("total_original"), "total_augmented"
    ).withColumn("total_combined", F.col("total_original") + F.col("total_augmented"))


def augmented_prompts(
    augmented: DataFrame, ddl: DataFrame, settings: PromptSettings = PromptSettings()
) -> DataFrame:
    """The rewrites as training texts."""
    text = format_prompt(F.col("question"), F.col("ddl"), F.col("query"), system_prompt=settings.system_prompt)
    return attach_ddl(augmented, ddl).withColumn("text", text).drop("ddl")


def training_mix(original: DataFrame, augmented: DataFrame, seed: int = 42) -> DataFrame:
    """Original and augmented rows with their ``place`` in one shuffled table; texts are attached afterwards.

    The place is a keyed hash of source, model, category, position, rewrite and copy, so it is unique and the same on any
    cluster.
    """
    columns = ["idx", "db_id", "question", "query"]
    none = F.lit(None).cast("string")
    plain = original.select(
        *columns, none.alias("augmentation_type"), F.lit(0).alias("copy"), none.alias("model_name"), none.alias("category")
    )
    made = augmented.select(*columns, "augmentation_type", "copy", "model_name", "category")
    key = [F.lit(str(seed)), F.col("idx").cast("string"), F.col("copy").cast("string")]
    key += [F.coalesce(c, F.lit("")) for c in ("augmentation_type", "model_name", "category")]
    both = plain.unionByName(made).withColumn("place", F.md5(F.concat_ws("|", *key)))
    return both.drop("copy", "model_name", "category")


def dealt(mix: DataFrame, partitions: int) -> DataFrame:
    """The rows of a mix in ``partitions`` partitions by the first 32 bits of their place, each in order of place.

    Partition p holds the p-th of equal ranges of places, so the partitions one after another, or the files written from
    them, are in one order. Places are hashes, hence ranges need no sampling and hold about the same number of rows.
    """
    prefix = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    number = F.shiftright(prefix * F.lit(partitions), 32).cast("int")
    # moved and sorted as 16 bytes, which are in the order of their 32 digits
    short = mix.withColumns({"_part": number, "place": F.unhex("place")}).repartitionById(partitions, "_part").drop("_part")
    return short.sortWithinPartitions("place").withColumn("place", F.lower(F.hex("place")))


def mixed_prompts(
    mix: DataFrame,
    ddl: DataFrame,
    settings: PromptSettings = PromptSettings(),
    partitions: int | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows of a mix with their training texts, in order of place over all partitions (``dealt``).

    Schema texts within the bound are broadcast to rows that lie in their places already, so no text is moved or
    sorted. Beyond it the join moves rows to their databases; they are dealt after it, texts included, or the table
    would be sorted by database.
    """
    partitions = partitions or int(mix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = written(ddl, "ddl")
    columns = ["place", "idx", "text", "db_id", "question", "query", "augmentation_type"]
    if file_bytes(ddl) <= max_bytes:
        # Spark drops a sort below a join, since joins keep no order in general; it doesn't look below a generator
        rows = evaluated_once(dealt(mix, partitions).withColumnRenamed("place", "_place"), place=F.col("_place"))
        return with_prompts(rows.drop("_place"), ddl, settings, max_bytes, stored=True).select(columns)
    return dealt(with_prompts(mix, ddl, settings, max_bytes, stored=True).select(columns), partitions)
