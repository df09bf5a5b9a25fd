"""One registered query per operator: (spark, folder) -> DataFrame of plain columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sqlgauge.functions import features as S
from sqlgauge.functions import text as X
from sqlgauge.operators import (
    accuracy,
    augmentation,
    corpus_stats,
    error_tables,
    execution,
    prompts,
    sampling,
    scoring,
    significance,
    taxonomy,
)
from sqlgauge.schemas import ERROR_PROFILE
from sqlgauge.session import new_path, written
from sqlgauge.sources import corpus, databases, results
from workload import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHIFTS = (("base", "round1"), ("round1", "round2"))


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _list(items: Column | str) -> Column:
    """A list as text; '-' for NULL."""
    return F.coalesce(F.array_join(items, "|"), F.lit("-"))


def _shown(value: Column) -> Column:
    """Any value as text; '-' for NULL."""
    return F.coalesce(value.cast("string"), F.lit("-"))


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_exact(inputs.predictions(spark, folder))


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The scored table without its texts, written once for queries that read it several times."""
    return written(_scored(spark, folder).select("model_name", "idx", "difficulty", "is_correct"), "outcomes")


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.schema_catalog(inputs.schema_examples(spark, folder))


def _columns(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.catalog_long(_catalog(spark, folder))


def _ddl(spark: SparkSession, folder: str) -> DataFrame:
    return written(prompts.schema_ddl(_catalog(spark, folder)), "ddl")


def _errors(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.classify_errors(_scored(spark, folder))


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return error_tables.error_profile(taxonomy.classify_errors(_scored(spark, folder), keep_correct=True))


def _classified(spark: SparkSession, folder: str, model: str | None = None, texts: bool = True) -> DataFrame:
    """The classified table, of one model or all, written once for queries that read it several times; some need no texts."""
    raw = inputs.predictions(spark, folder)
    raw = raw if model is None else raw.filter(F.col("model_name") == model)
    rows = taxonomy.classify_errors(scoring.score_exact(raw), keep_correct=True)
    columns = ("model_name", *(("idx", "db_id", "question", "gold_sql") if texts else ("db_id",)), "difficulty", "is_correct")
    return written(rows.select(*columns, "categories", "primary_category"), "classified")


# ---- scans, sources, sinks


def _corpus_files(spark: SparkSession, folder: str, split: Column) -> str:
    """The training rows with their nested schemas in a corpus's file layout, one folder per split."""
    path = new_path(spark, "corpus")
    toks = F.split("query", " ")
    files = inputs.train(spark, folder).select(
        "db_id", "query", "question", toks.alias("query_toks"), toks.alias("query_toks_no_value"),
        F.split("question", " ").alias("question_toks"), split.alias("split"),
    )
    for name in ("train", "validation", "test"):
        files.filter(F.col("split") == name).drop("split").write.parquet(f"{path}/{name}.parquet")
    return f"{path}/*.parquet"


@query
def load_examples(spark: SparkSession, folder: str) -> DataFrame:
    """A1: the corpus written in its file layout, one folder per split, and read back."""
    found = corpus.load_examples(spark, _corpus_files(spark, folder, F.col("split")))
    return found.select(
        "split", "db_id", "question", "query",
        F.size("query_toks").alias("n_query_toks"), F.size("question_toks").alias("n_question_toks"),
    )


@query
def load_examples_positions(spark: SparkSession, folder: str) -> DataFrame:
    """A1 with a third split: rows, distinct positions and smallest position of each split."""
    third = F.when(F.col("idx") % 7 == 0, "test").otherwise(F.col("split"))
    found = corpus.load_examples(spark, _corpus_files(spark, folder, third))
    return found.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.count_distinct("idx").alias("n_positions"), F.min("idx").alias("first_idx")
    )


@query
def split_examples(spark: SparkSession, folder: str) -> DataFrame:
    """A2"""
    rows = sampling.split_examples(inputs.train(spark, folder).drop("split"))
    return rows.select("idx", "split")


@query
def split_examples_kept(spark: SparkSession, folder: str) -> DataFrame:
    """A2 on a corpus that has a validation split: it stays as it is."""
    return sampling.split_examples(inputs.train(spark, folder)).select("idx", "split")


@query
def subset_of_splits(spark: SparkSession, folder: str) -> DataFrame:
    """A3 by split: the first rows of each."""
    found = sampling.subset(inputs.train(spark, folder), {"train": 700, "validation": 90})
    return found.select("split", "idx", "db_id")


@query
def take_first(spark: SparkSession, folder: str) -> DataFrame:
    """A3: a short prefix of the training rows."""
    return sampling.take_first(inputs.train(spark, folder), 500).select("idx", "db_id", "query")


@query
def take_first_long(spark: SparkSession, folder: str) -> DataFrame:
    """A3: a prefix too long for one task."""
    return sampling.take_first(inputs.train(spark, folder), 12_000).select("idx", "db_id", "query")


@query
def schema_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A4"""
    return _catalog(spark, folder).select(
        "db_id",
        _list("table_names").alias("table_names"),
        _list(F.transform("columns", lambda c: F.concat_ws(":", c["table_idx"].cast("string"), c["name"]))).alias("columns"),
        _list("column_types").alias("column_types"),
    )


@query
def catalog_long(spark: SparkSession, folder: str) -> DataFrame:
    """A5"""
    keys = F.transform("fks", lambda k: F.concat_ws(":", k["fk_pos"].cast("string"), k["ref_table"], k["ref_column"]))
    return _columns(spark, folder).withColumn("fks", _list(keys))


@query
def write_result(spark: SparkSession, folder: str) -> DataFrame:
    """A6: accuracy by difficulty saved as JSON, one folder per model, and read as written."""
    path = new_path(spark, "result")
    found = accuracy.accuracy_by_difficulty(_scored(spark, folder))
    results.write_result(found, path, "json")
    return spark.read.schema(found.schema).json(path).select(*found.columns)


@query
def write_result_models(spark: SparkSession, folder: str) -> DataFrame:
    """A6: three models saved by three calls under one path, one of them twice, and all read back."""
    path = new_path(spark, "results")
    found = written(accuracy.accuracy_by_difficulty(_scored(spark, folder)), "accuracy")
    results.write_result(found.filter(F.col("model_name") == "round1").limit(1), path)
    for name, _, _ in inputs.MODELS:
        results.write_result(found.filter(F.col("model_name") == name), path)
    return spark.read.schema(found.schema).json(path).select(*found.columns)


@query
def read_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """A7: a saved error profile read back and ranked."""
    path = new_path(spark, "analysis")
    results.write_result(_profile(spark, folder), path, "json")
    profile = results.read_analysis(spark, path, ERROR_PROFILE)
    return error_tables.ranked_weaknesses(error_tables.category_distribution(profile))


@query
def register_databases(spark: SparkSession, folder: str) -> DataFrame:
    """A8: the given folder as a database beside one that shares a table name with it; each sees its own tables only."""
    root = new_path(spark, "databases")
    inputs.table(spark, folder, "nation").write.parquet(f"{root}/other/orders.parquet")
    parent, _, name = folder.rstrip("/").rpartition("/")
    places = {"given": (databases.register_databases(spark, parent), name), "other": (databases.register_databases(spark, root), "other")}
    counts = [
        found.session(db).sql(f"SELECT '{shown}' AS db_id, '{table}' AS table_name, count(*) AS n_rows FROM {table}")
        for shown, (found, db) in places.items()
        for table in found.tables(db)
    ]
    return reduce(DataFrame.unionByName, counts)


# ---- SQL text


@query
def extract_sql(spark: SparkSession, folder: str) -> DataFrame:
    """B1"""
    rows = inputs.predictions(spark, folder)
    return rows.select("model_name", "idx", X.extract_sql(F.col("raw_output")).alias("pred_sql"))


@query
def extract_sql_chat(spark: SparkSession, folder: str) -> DataFrame:
    """B1 on text that is mostly not SQL."""
    rows = inputs.chat_outputs(spark, folder)
    return rows.select("conv_id", "turn", X.extract_sql(F.col("raw_output")).alias("pred_sql"))


@query
def normalize_sql(spark: SparkSession, folder: str) -> DataFrame:
    """B2"""
    rows = scoring.clean_predictions(inputs.predictions(spark, folder))
    return rows.select("model_name", "idx", X.normalize_sql(F.col("pred_sql")).alias("norm_sql"))


@query
def normalize_documents(spark: SparkSession, folder: str) -> DataFrame:
    """B2 on whole documents."""
    rows = inputs.long_questions(spark, folder)
    norm = X.normalize_sql(F.col("question"))
    return rows.select("idx", F.md5(norm).alias("norm_md5"), F.length(norm).alias("norm_length"))


@query
def example_hash(spark: SparkSession, folder: str) -> DataFrame:
    """B3"""
    rows = inputs.train(spark, folder)
    return rows.select("idx", X.example_hash(F.col("db_id"), F.col("question")).alias("example_hash"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted SQL of every output and a text for every order, each distinct one with its number of rows."""
    rows = scoring.clean_predictions(inputs.predictions(spark, folder)).select(F.col("pred_sql").alias("sql"))
    rows = rows.unionByName(inputs.varied_texts(spark, folder))
    return rows.groupBy("sql").agg(F.count("*").alias("n"))


@query
def sql_tables(spark: SparkSession, folder: str) -> DataFrame:
    """B4"""
    return _texts(spark, folder).withColumn("tables", _list(S.sql_tables(F.col("sql"))))


@query
def sql_joins(spark: SparkSession, folder: str) -> DataFrame:
    """B5"""
    joins = F.transform(S.sql_joins(F.col("sql")), lambda j: F.concat_ws(":", j["type"], j["table"]))
    return _texts(spark, folder).withColumn("joins", _list(joins))


@query
def sql_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """B6"""
    return _texts(spark, folder).withColumn("aggregates", _list(S.sql_aggregates(F.col("sql"))))


@query
def subquery_count(spark: SparkSession, folder: str) -> DataFrame:
    """B7"""
    return _texts(spark, folder).withColumn("subqueries", S.subquery_count(F.col("sql")))


@query
def sql_group_by(spark: SparkSession, folder: str) -> DataFrame:
    """B8"""
    return _texts(spark, folder).withColumn("group_by", _list(S.sql_group_by(F.col("sql"))))


@query
def sql_having(spark: SparkSession, folder: str) -> DataFrame:
    """B9"""
    return _texts(spark, folder).withColumn("having_text", _shown(S.sql_having(F.col("sql"))))


@query
def sql_where(spark: SparkSession, folder: str) -> DataFrame:
    """B10"""
    return _texts(spark, folder).withColumn("where_text", _shown(S.sql_where(F.col("sql"))))


@query
def sql_features(spark: SparkSession, folder: str) -> DataFrame:
    """B11 for every prediction, inside the projection that reads it."""
    rows = scoring.clean_predictions(inputs.predictions(spark, folder))
    found = rows.select("model_name", "idx", S.sql_features(F.col("pred_sql")).alias("f"))
    return found.select(
        "model_name",
        "idx",
        _list("f.tables").alias("tables"),
        F.size("f.joins").alias("n_joins"),
        _list("f.aggregations").alias("aggregates"),
        _shown(F.col("f.where_cond")).alias("where_text"),
        F.col("f.subquery_count").alias("subqueries"),
        _list("f.group_by").alias("group_by"),
        _shown(F.col("f.having")).alias("having_text"),
        F.col("f.is_valid").alias("is_valid"),
    )


@query
def sql_operators(spark: SparkSession, folder: str) -> DataFrame:
    """B12"""
    return _texts(spark, folder).withColumn("operators", _list(S.sql_operators(F.col("sql"))))


@query
def condition_column_refs(spark: SparkSession, folder: str) -> DataFrame:
    """B13"""
    sql = F.col("sql")
    refs = S.condition_column_refs(S.sql_where(sql), S.sql_having(sql), S.sql_group_by(sql))
    return _texts(spark, folder).withColumn("refs", _list(refs))


@query
def keyword_flags(spark: SparkSession, folder: str) -> DataFrame:
    """B14"""
    return _texts(spark, folder).withColumn("keywords", _list(X.keyword_flags(F.col("sql"))))


@query
def simplify_condition(spark: SparkSession, folder: str) -> DataFrame:
    """B15"""
    return _texts(spark, folder).withColumn("words", _shown(X.simplify_condition(S.sql_where(F.col("sql")))))


# ---- schema text and prompts


@query
def schema_ddl(spark: SparkSession, folder: str) -> DataFrame:
    """C1"""
    return prompts.schema_ddl(_catalog(spark, folder))


@query
def schema_ddl_plain(spark: SparkSession, folder: str) -> DataFrame:
    """C1 without types and foreign keys."""
    return prompts.schema_ddl(_catalog(spark, folder), types=False, fks=False)


@query
def attach_ddl(spark: SparkSession, folder: str) -> DataFrame:
    """C2"""
    found = prompts.attach_ddl(inputs.train(spark, folder), _ddl(spark, folder))
    return found.select("idx", "db_id", "ddl")


@query
def catalog_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """C3"""
    return corpus.catalog_sizes(_catalog(spark, folder))


@query
def format_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """C4 for training."""
    return prompts.with_prompts(inputs.train(spark, folder), _ddl(spark, folder)).select("idx", "text")


@query
def inference_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """C4 left open for a model."""
    return prompts.inference_prompts(inputs.train(spark, folder), _ddl(spark, folder)).select("idx", "text")


@query
def prepare_training_data(spark: SparkSession, folder: str) -> DataFrame:
    """C5 on whole documents as questions."""
    kept = prompts.prepare_training_data(inputs.long_questions(spark, folder), _ddl(spark, folder))
    return kept.select("idx", "db_id", F.md5("text").alias("text_md5"), F.length("text").alias("text_length"))


@query
def training_drops(spark: SparkSession, folder: str) -> DataFrame:
    """C5: what the length limit dropped."""
    return prompts.training_drops(inputs.long_questions(spark, folder), _ddl(spark, folder))


# ---- scores


@query
def prepare_training_counts(spark: SparkSession, folder: str) -> DataFrame:
    """C5: what one pass over whole documents keeps, beside the counts taken in that pass."""
    counts = Observation("training prompts")
    ddl = _ddl(spark, folder)
    kept = written(prompts.prepare_training_data(inputs.long_questions(spark, folder), ddl, counts=counts), "prompts")
    named = [F.lit(counts.get[name]).alias(name) for name in ("examples", "kept", "dropped")]
    return kept.agg(F.count("*").alias("read"), F.sum(F.length("text")).alias("characters")).select(*named, "read", "characters")


@query
def score_exact(spark: SparkSession, folder: str) -> DataFrame:
    """D1"""
    return _scored(spark, folder).select("model_name", "idx", "is_correct")


@query
def exact_details(spark: SparkSession, folder: str) -> DataFrame:
    """D1: the record of each text comparison."""
    found = scoring.exact_details(_scored(spark, folder))
    return found.select("model_name", "idx", "details.method", "details.norm_pred", "details.norm_gold")


@query
def result_sets_equal_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """D2: order lines against the same lines sorted and repeated, with whole numbers as doubles."""
    lines = inputs.table(spark, folder, "lineitem")
    a = lines.select("l_partkey", "l_quantity", "l_returnflag")
    b = lines.select(F.col("l_partkey").cast("double"), F.col("l_quantity").cast("int"), "l_returnflag")
    return execution.compare_result_sets(a, b.unionAll(b))


@query
def result_sets_equal(spark: SparkSession, folder: str) -> DataFrame:
    """D2: all line items, and the same with repeats, other order and another discount where the quantity is eleven."""
    lines = inputs.table(spark, folder, "lineitem")
    other = F.when(F.col("l_quantity") == 11, F.col("l_discount") + 1.0).otherwise(F.col("l_discount"))
    a = lines.select("l_orderkey", "l_returnflag", "l_discount")
    b = lines.select("l_orderkey", "l_returnflag", other.alias("l_discount"))
    return execution.compare_result_sets(a, b.unionAll(b))


def _amounts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All order lines with a large exact amount, and with one that differs in the last cent or the twelfth digit."""
    lines = inputs.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    exact = (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).cast("decimal(15,2)") + F.lit("12345678.91").cast("decimal(15,2)")
    near = F.col("l_orderkey") % 7 == 0
    a = lines.select("l_orderkey", "l_linenumber", exact.alias("amount"))
    b = lines.select("l_orderkey", "l_linenumber", F.when(near, exact + F.lit("0.01").cast("decimal(15,2)")).otherwise(exact).alias("amount"))
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    c = lines.select(place.alias("place"), (F.lit(123456789.125) + place).alias("amount"))
    d = lines.select(place.alias("place"), (F.lit(123456789.125) + place + F.when(near, 0.001).otherwise(0.0)).alias("amount"))
    return a, b, c.select("place", "amount", F.lit(0).alias("side")).union(d.select("place", "amount", F.lit(1).alias("side")))


@query
def result_sets_last_cent(spark: SparkSession, folder: str) -> DataFrame:
    """D2: decimals that differ in the last cent only."""
    a, b, _ = _amounts(spark, folder)
    return execution.compare_result_sets(a, b)


@query
def result_sets_twelfth_digit(spark: SparkSession, folder: str) -> DataFrame:
    """D2: doubles that differ in the twelfth digit only."""
    _, _, both = _amounts(spark, folder)
    sides = [both.filter(F.col("side") == s).drop("side") for s in (0, 1)]
    return execution.compare_result_sets(*sides)


@query
def result_digests_differ(spark: SparkSession, folder: str) -> DataFrame:
    """D3: digests of sets that differ in the last cent, and of a set and its repeats."""
    a, b, _ = _amounts(spark, folder)
    first, second, third = (execution.result_digest(x).withColumn("side", F.lit(s)) for s, x in enumerate((a, b, a.unionAll(a))))
    of = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name)))
    return first.union(second).union(third).agg(
        of(0, "n_rows").alias("n_rows"),
        (of(0, "digest") == of(1, "digest")).alias("same"),
        (of(0, "digest") == of(2, "digest")).alias("repeated"),
    )


@query
def result_digest(spark: SparkSession, folder: str) -> DataFrame:
    """D3: the size of the set of order lines, and whether repeats leave the digest alone."""
    lines = inputs.table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus")
    once, twice = execution.result_digest(lines), execution.result_digest(lines.unionAll(lines))
    return once.join(twice.withColumnRenamed("digest", "other"), ["width", "n_rows"]).select(
        "width", "n_rows", (F.col("digest") == F.col("other")).alias("same")
    )


@query
def score_execution(spark: SparkSession, folder: str) -> DataFrame:
    """D4: every prediction run on the given tables."""
    names = ("region", "nation", "customer", "supplier", "part")
    found = databases.Databases(spark, {"shop": {n: f"{folder}/{n}.parquet" for n in names}})
    rows = inputs.predictions(spark, folder).withColumn("database", F.lit("shop"))
    scored = execution.score_execution(rows, found, database="database")
    return scored.select("model_name", "idx", "is_correct", "gold_success", "pred_success", "method")


@query
def score_execution_errors(spark: SparkSession, folder: str) -> DataFrame:
    """D4 over two databases that share a table name, a statement of its own in each row, with the record of both sides."""
    root = new_path(spark, "two")
    inputs.table(spark, folder, "nation").write.parquet(f"{root}/one/places.parquet")
    inputs.table(spark, folder, "region").write.parquet(f"{root}/two/places.parquet")
    part = inputs.table(spark, folder, "part").select(F.col("p_partkey").alias("idx"))
    key, number = F.col("idx"), F.col("idx").cast("string")
    own = F.concat(F.lit("SELECT count(*) FROM places WHERE "), number, F.lit(" > 0"))
    gold = F.when((key % 5).isin(1, 4), own).otherwise("SELECT count(*) FROM places")
    total = F.when(key % 2 == 0, "25").otherwise("5")
    pred = (
        F.when(key % 5 == 0, F.concat(F.lit("SELECT missing FROM places LIMIT "), number))
        .when(key % 5 == 1, F.lit("SELECT 1 / (count(*) - count(*)) FROM places"))
        .when(key % 5 == 2, F.concat(F.lit("SELECT "), total, F.lit(" + 0 * "), number))
        .when(key % 5 == 3, F.concat(F.lit("SELECT n_regionkey FROM places WHERE n_nationkey < "), number))
        .otherwise(F.lit(""))
    )
    rows = part.select("idx", F.when(key % 2 == 0, "one").otherwise("two").alias("db_id"), gold.alias("gold_sql"), pred.alias("pred_sql"))
    scored = execution.score_execution(rows, databases.register_databases(spark, root))
    return scored.select(
        "idx", F.col("is_correct").alias("match"), "gold_success", "pred_success", _shown(F.col("gold_error")).alias("gold_error"),
        _shown(F.col("pred_error")).alias("pred_error"),
    )


@query
def difficulty_summary(spark: SparkSession, folder: str) -> DataFrame:
    """D10 with the levels."""
    found = significance.difficulty_summary(_outcomes(spark, folder))
    return _rounded(found, "accuracy", "ci_lower", "ci_upper", "level_accuracy")


@query
def accuracy_overall(spark: SparkSession, folder: str) -> DataFrame:
    """D5"""
    return accuracy.accuracy_overall(_scored(spark, folder))


@query
def accuracy_by_difficulty(spark: SparkSession, folder: str) -> DataFrame:
    """D6"""
    return accuracy.accuracy_by_difficulty(_scored(spark, folder))


@query
def accuracy_by_database(spark: SparkSession, folder: str) -> DataFrame:
    """D7"""
    return accuracy.accuracy_by_database(_scored(spark, folder))


@query
def running_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """D8 on dense positions."""
    return accuracy.running_accuracy(_scored(spark, folder), dense=True)


@query
def running_accuracy_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """D8 on positions with gaps."""
    return accuracy.running_accuracy(inputs.event_scores(spark, folder))


@query
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """D9"""
    return _rounded(significance.bootstrap_ci(_scored(spark, folder)), "mean", "ci_lower", "ci_upper")


@query
def bootstrap_ci_labels(spark: SparkSession, folder: str) -> DataFrame:
    """D9 on labelled documents."""
    return _rounded(significance.bootstrap_ci(inputs.paired_scores(spark, folder)), "mean", "ci_lower", "ci_upper")


@query
def model_summary(spark: SparkSession, folder: str) -> DataFrame:
    """D10"""
    return _rounded(significance.model_summary(_outcomes(spark, folder)), "accuracy", "ci_lower", "ci_upper")


@query
def mcnemar_table(spark: SparkSession, folder: str) -> DataFrame:
    """D11"""
    return significance.mcnemar_table(_outcomes(spark, folder))


@query
def mcnemar_test(spark: SparkSession, folder: str) -> DataFrame:
    """D12"""
    scored = _outcomes(spark, folder)
    found = significance.mcnemar_test(significance.mcnemar_table(scored), accuracy.accuracy_overall(scored))
    return _rounded(found, "accuracy_a", "accuracy_b", "mcnemar_chi2", "p_value")


@query
def mcnemar_test_labels(spark: SparkSession, folder: str) -> DataFrame:
    """D12 on labelled documents."""
    scored = inputs.paired_scores(spark, folder)
    found = significance.mcnemar_test(significance.mcnemar_table(scored), accuracy.accuracy_overall(scored))
    return _rounded(found, "accuracy_a", "accuracy_b", "mcnemar_chi2", "p_value")


@query
def accuracy_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """D13"""
    scored = _outcomes(spark, folder)
    found = accuracy.accuracy_pivot(scored, significance.bootstrap_ci(scored))
    return _rounded(found, "overall", "easy", "medium", "hard", "extra", "ci_lower", "ci_upper")


@query
def accuracy_grid(spark: SparkSession, folder: str) -> DataFrame:
    """D13: all models by all difficulties."""
    return _rounded(accuracy.accuracy_grid(_scored(spark, folder)), "accuracy")


# ---- errors


def _check(spark: SparkSession, folder: str, group: str, **columns: Column) -> DataFrame:
    """Wrong predictions with the given parts of one detail group."""
    errors = _errors(spark, folder).filter(F.col(f"details.{group}").isNotNull())
    return errors.select("model_name", "idx", *[c.alias(n) for n, c in columns.items()])


@query
def check_syntax(spark: SparkSession, folder: str) -> DataFrame:
    """T1"""
    return _check(
        spark, folder, "syntax",
        error_type=F.col("details.syntax.type"), description=F.col("details.syntax.description"),
    )


@query
def check_schema_linking(spark: SparkSession, folder: str) -> DataFrame:
    """T2 with a catalog."""
    rows = _scored(spark, folder).select("model_name", "idx", "db_id", "gold_sql", "pred_sql", "is_correct")
    errors = taxonomy.classify_errors(written(rows, "scored"), written(_columns(spark, folder), "catalog"))
    found = F.col("details.schema_linking")
    return errors.filter(found.isNotNull()).select(
        "model_name",
        "idx",
        _list(found["missing_tables"]).alias("missing_tables"),
        _list(found["extra_tables"]).alias("extra_tables"),
        _list(found["hallucinated_columns"]).alias("hallucinated_columns"),
    )


@query
def check_joins(spark: SparkSession, folder: str) -> DataFrame:
    """T3"""
    d = "details.join_errors"
    return _check(
        spark, folder, "join_errors",
        pred_joins=_shown(F.col(f"{d}.join_count_mismatch.predicted")),
        gold_joins=_shown(F.col(f"{d}.join_count_mismatch.gold")),
        pred_types=_list(f"{d}.join_type_mismatch.predicted"),
        gold_types=_list(f"{d}.join_type_mismatch.gold"),
        missing_join_tables=_list(f"{d}.missing_join_tables"),
        extra_join_tables=_list(f"{d}.extra_join_tables"),
    )


@query
def check_aggregation(spark: SparkSession, folder: str) -> DataFrame:
    """T4"""
    d = "details.aggregation"
    return _check(
        spark, folder, "aggregation",
        pred_aggs=_list(f"{d}.aggregation_mismatch.predicted"),
        gold_aggs=_list(f"{d}.aggregation_mismatch.gold"),
        pred_has_group_by=_shown(F.col(f"{d}.group_by_presence.predicted_has_group_by")),
        pred_group_by=_list(f"{d}.group_by_columns.predicted"),
        gold_group_by=_list(f"{d}.group_by_columns.gold"),
        pred_has_having=_shown(F.col(f"{d}.having_presence.predicted_has_having")),
    )


@query
def check_filter(spark: SparkSession, folder: str) -> DataFrame:
    """T5"""
    d = "details.filter_condition"
    return _check(
        spark, folder, "filter_condition",
        pred_has_where=_shown(F.col(f"{d}.where_presence.predicted_has_where")),
        pred_operators=_list(f"{d}.operator_mismatch.predicted"),
        gold_operators=_list(f"{d}.operator_mismatch.gold"),
        pred_has_limit=_shown(F.col(f"{d}.limit_mismatch.predicted_has_limit")),
    )


@query
def check_nesting(spark: SparkSession, folder: str) -> DataFrame:
    """T6"""
    d = "details.nesting.subquery_count_mismatch"
    return _check(spark, folder, "nesting", pred_subqueries=F.col(f"{d}.predicted"), gold_subqueries=F.col(f"{d}.gold"))


@query
def classify_errors(spark: SparkSession, folder: str) -> DataFrame:
    """T7"""
    return _errors(spark, folder).select(
        "model_name",
        "idx",
        _list("categories").alias("categories"),
        "primary_category",
        "severity",
        _shown(F.col("details.fallback")).alias("fallback"),
    )


@query
def error_summary(spark: SparkSession, folder: str) -> DataFrame:
    """T8"""
    return error_tables.error_summary(_profile(spark, folder))


@query
def category_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """T9"""
    found = error_tables.category_distribution(_profile(spark, folder))
    return _rounded(found, "pct_of_errors", "pct_of_total")


@query
def primary_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """T10"""
    return _rounded(error_tables.primary_distribution(_profile(spark, folder)), "pct_of_errors")


@query
def difficulty_error_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """T11"""
    return error_tables.difficulty_error_pivot(_profile(spark, folder))


@query
def matrix_row_percent(spark: SparkSession, folder: str) -> DataFrame:
    """T12"""
    matrix = error_tables.difficulty_error_matrix(_profile(spark, folder))
    return _rounded(error_tables.matrix_row_percent(matrix), "pct_of_row")


@query
def ranked_weaknesses(spark: SparkSession, folder: str) -> DataFrame:
    """T13"""
    distribution = error_tables.category_distribution(_profile(spark, folder))
    return _rounded(error_tables.ranked_weaknesses(distribution, 3), "error_rate")


@query
def distribution_shift(spark: SparkSession, folder: str) -> DataFrame:
    """T14"""
    found = error_tables.distribution_shift(written(_profile(spark, folder), "profile"), SHIFTS)
    return _rounded(found, "before_pct", "after_pct", "change_pct", "accuracy_change")


# ---- augmentation


def _weak(classified: DataFrame) -> DataFrame:
    distribution = error_tables.category_distribution(error_tables.error_profile(classified))
    return written(augmentation.weak_categories(error_tables.ranked_weaknesses(distribution)), "weak")


def _errors_of(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("categories").isNotNull())


def _error_databases(classified: DataFrame, weak: DataFrame) -> DataFrame:
    return written(augmentation.error_databases(_errors_of(classified), weak), "error-databases")


def _related_to_errors(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    """Training rows related to errors, once per category with their models."""
    classified = _classified(spark, folder, model, texts=False)
    return augmentation.related_by_category(inputs.train(spark, folder), _error_databases(classified, _weak(classified)))


def _examples(spark: SparkSession, folder: str, category: str) -> DataFrame:
    """Every training row as an example of one category."""
    return inputs.train(spark, folder).withColumn("category", F.lit(category))


def _rewrites(spark: SparkSession, folder: str, category: str, name: str) -> DataFrame:
    made = augmentation.augment(_examples(spark, folder, category))
    return made.filter(F.col("augmentation_type") == name).select("idx", "copy", "question")


@query
def weak_categories(spark: SparkSession, folder: str) -> DataFrame:
    """F1"""
    return _rounded(_weak(_classified(spark, folder)), "error_rate")


@query
def error_examples(spark: SparkSession, folder: str) -> DataFrame:
    """F2"""
    classified = _classified(spark, folder)
    found = augmentation.error_examples(_errors_of(classified), _weak(classified))
    return found.select("model_name", "category", "idx", "db_id")


@query
def related_examples(spark: SparkSession, folder: str) -> DataFrame:
    """F3"""
    classified = _classified(spark, folder)
    found = augmentation.related_examples(inputs.train(spark, folder), _error_databases(classified, _weak(classified)))
    return found.select("model_name", "category", "idx", "db_id")


def _register_rewrites() -> None:
    """F4-F13: each rewrite applied to every training row."""
    from sqlgauge.functions.rewrites import RULES

    for rule in RULES:
        QUERIES[f"rewrite_{rule.name}"] = (
            lambda spark, folder, rule=rule: _rewrites(spark, folder, rule.category, rule.name)
        )


_register_rewrites()


@query
def augment(spark: SparkSession, folder: str) -> DataFrame:
    """F14"""
    made = augmentation.augment(_related_to_errors(spark, folder))
    return made.select("model_name", "category", "idx", "copy", "db_id", "augmentation_type", "question")


@query
def augmentation_stats(spark: SparkSession, folder: str) -> DataFrame:
    """F15"""
    classified = _classified(spark, folder)
    weak = _weak(classified)
    train, found = inputs.train(spark, folder), _error_databases(classified, weak)
    shown = augmentation.error_sources(augmentation.error_examples(_errors_of(classified), weak))
    sources = augmentation.related_examples(train, found).select(*shown.columns).unionByName(shown)
    made = augmentation.augment(augmentation.related_by_category(train, found)).unionByName(augmentation.augment(shown))
    return augmentation.augmentation_stats(sources, made)


@query
def augmentation_totals(spark: SparkSession, folder: str) -> DataFrame:
    """totals."""
    return augmentation.augmentation_totals(
        inputs.train(spark, folder), augmentation.augment(_related_to_errors(spark, folder))
    )


@query
def training_mix(spark: SparkSession, folder: str) -> DataFrame:
    """F16 for one model's round."""
    ddl, train = _ddl(spark, folder), inputs.train(spark, folder)
    rows = augmentation.augment(_related_to_errors(spark, folder, "round1"))
    place = augmentation.training_mix(prompts.prepare_training_data(train, ddl), rows)
    mix = augmentation.mixed_prompts(place, ddl)
    kind = _shown(F.col("augmentation_type")).alias("augmentation_type")
    return mix.select("place", "idx", "db_id", kind, F.md5("text").alias("text_md5"))


@query
def training_mix_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """F16 where no schema text is small enough to be broadcast: rows, databases and places of each partition."""
    ddl = _ddl(spark, folder)
    every = [F.lit(None).cast("string").alias(n) for n in ("augmentation_type", "model_name", "category")]
    train = inputs.train(spark, folder)
    made = train.select("idx", "db_id", "question", "query", *every, F.lit(1).alias("copy"))
    mix = augmentation.mixed_prompts(augmentation.training_mix(train, made), ddl, partitions=8, max_bytes=0)
    return mix.groupBy(F.spark_partition_id().alias("part")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("db_id").alias("n_databases"), F.min("place").alias("first"), F.max("place").alias("last")
    )


# ---- corpus statistics


@query
def corpus_counts(spark: SparkSession, folder: str) -> DataFrame:
    """G1"""
    return corpus_stats.corpus_counts(inputs.train(spark, folder))


@query
def length_stats(spark: SparkSession, folder: str) -> DataFrame:
    """G2"""
    found = corpus_stats.length_stats(inputs.train(spark, folder))
    return _rounded(found, "avg_query_length", "avg_question_length")


@query
def histogram_query_length(spark: SparkSession, folder: str) -> DataFrame:
    """G3"""
    found = corpus_stats.histogram(inputs.train(spark, folder), F.length("query"), 50)
    return _rounded(found, "bin_start", "bin_end")


@query
def histogram_question_length(spark: SparkSession, folder: str) -> DataFrame:
    """G3 on whole documents."""
    found = corpus_stats.histogram(inputs.long_questions(spark, folder), F.length("question"), 50)
    return _rounded(found, "bin_start", "bin_end")


@query
def histogram_columns(spark: SparkSession, folder: str) -> DataFrame:
    """G3 on schema sizes."""
    sizes = corpus.catalog_sizes(_catalog(spark, folder))
    return _rounded(corpus_stats.histogram(sizes, F.col("n_columns"), 30), "bin_start", "bin_end")


@query
def keyword_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """G4"""
    return corpus_stats.keyword_distribution(inputs.train(spark, folder))


@query
def schema_size_stats(spark: SparkSession, folder: str) -> DataFrame:
    """G5"""
    found = corpus_stats.schema_size_stats(corpus.catalog_sizes(_catalog(spark, folder)))
    return _rounded(found, "avg_tables", "avg_columns")
