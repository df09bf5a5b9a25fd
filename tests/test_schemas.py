"""Catalogs, prompts, statistics, files and plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, queries
from sqlgauge.operators import augmentation, corpus_stats, prompts
from sqlgauge.plans import stages
from sqlgauge.schemas import ERROR_PROFILE, NESTED_CATALOG
from sqlgauge.session import new_path, written
from sqlgauge.settings import PromptSettings, Settings
from sqlgauge.sources import corpus, results
from tests.conftest import DATA
from workload import inputs

SHOP = {
    "db_id": "shop",
    "table_names": ["a", "b"],
    "columns": [(-1, "*"), (0, "id"), (1, "id"), (0, "b_id"), (1, "name")],
    "column_types": ["text", "number", "number", "number"],
    "foreign_keys": [(3, 2), (3, 9), (0, 2), (3, 4)],
    "primary_keys": [1, 2],
}
DDL = (
    "CREATE TABLE a (\n  id number PRIMARY KEY,\n  b_id number,\n  FOREIGN KEY (b_id) REFERENCES b(id),\n"
    "  FOREIGN KEY (b_id) REFERENCES b(name)\n);\n\nCREATE TABLE b (\n  id number PRIMARY KEY,\n  name\n);"
)


def catalog(spark, *rows):
    return spark.createDataFrame([tuple(r[f] for f in NESTED_CATALOG.fieldNames()) for r in rows], NESTED_CATALOG)


def test_ddl(spark):
    empty = {**SHOP, "db_id": "empty", "columns": [(-1, "*")], "foreign_keys": []}
    broken = {**SHOP, "db_id": "broken", "columns": [(0, "x"), (7, "y")], "foreign_keys": []}
    found = {r.db_id: r.ddl for r in prompts.schema_ddl(catalog(spark, SHOP, empty, broken)).collect()}
    assert found == {"shop": DDL, "empty": "", "broken": None}
    plain = prompts.schema_ddl(catalog(spark, SHOP), types=False, fks=False).first().ddl
    assert plain == "CREATE TABLE a (\n  id PRIMARY KEY,\n  b_id\n);\n\nCREATE TABLE b (\n  id PRIMARY KEY,\n  name\n);"


def test_catalog_sizes(spark):
    assert tuple(corpus.catalog_sizes(catalog(spark, SHOP)).first()) == ("shop", 2, 4)


def test_prompts(spark):
    rows = spark.createDataFrame(
        [(0, "shop", "Q?", "SELECT 1"), (1, "gone", "Q" * 5000, "SELECT 1"), (2, "broken", "Q?", "SELECT 1")],
        "idx long, db_id string, question string, query string",
    )
    ddl = spark.createDataFrame([("shop", DDL), ("broken", None)], "db_id string, ddl string")
    settings = PromptSettings(system_prompt="S")
    texts = {r.idx: r.text for r in prompts.with_prompts(rows, ddl, settings).collect()}
    start = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|>"
    user = "<|start_header_id|>user<|end_header_id|>\n\nGiven the following database schema:\n\n{}\n\nQuestion: {}<|eot_id|>"
    answer = "<|start_header_id|>assistant<|end_header_id|>\n\n"
    assert texts[0] == start + user.format(DDL, "Q?") + answer + "SELECT 1<|eot_id|>"
    assert "\n\n-- Unknown database: gone\n\n" in texts[1] and texts[2] is None
    asked = {r.idx: r.text for r in prompts.inference_prompts(rows, ddl, settings).collect()}
    assert asked[0] == start + user.format(DDL, "Q?") + answer
    assert [r.idx for r in prompts.prepare_training_data(rows, ddl, settings).collect()] == [0]
    assert tuple(prompts.training_drops(rows, ddl, settings).first()) == (3, 1, 2)
    none = spark.range(1).select(prompts.format_prompt(F.lit("Q"), F.lit("D"), respond=False, system_prompt="S")).first()[0]
    assert none == start + user.format("D", "Q")


def test_load_examples_numbers_rows_by_file(spark, tmp_path):
    def save(name, rows):
        frame = pd.DataFrame({"db_id": ["d"] * len(rows), "query": rows, "question": rows})
        for c in ("query_toks", "query_toks_no_value", "question_toks"):
            frame[c] = [[r] for r in rows]
        frame.to_parquet(tmp_path / name)

    save("train-00000-of-00002.parquet", ["a", "b"])
    save("train-00001-of-00002.parquet", ["c"])
    save("validation-00000-of-00001.parquet", ["d"])
    found = corpus.load_examples(spark, str(tmp_path)).orderBy("split", "idx").collect()
    assert [(r.split, r.idx, r["query"]) for r in found] == [
        ("train", 0, "a"),
        ("train", 1, "b"),
        ("train", 1 << 40, "c"),
        ("validation", 0, "d"),
    ]


@pytest.mark.parametrize("values", [[3.0] * 4, [1, 2, 2, 10], list(range(0, 300, 7)), [0.1 * i for i in range(100)]])
@pytest.mark.parametrize("bins", [1, 7, 50])
def test_histogram_equals_numpy(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = corpus_stats.histogram(df, F.col("v"), bins).orderBy("bin").collect()
    counts, edges = np.histogram(np.array(values, dtype=float), bins=bins)
    assert [r["count"] for r in found] == counts.tolist()
    assert np.allclose([r.bin_start for r in found] + [found[-1].bin_end], edges)


def test_saved_results_come_back(spark):
    row = ("m", "easy", 5, 2, *range(12))
    path = new_path(spark, "saved")
    results.write_result(spark.createDataFrame([row], ERROR_PROFILE), path)
    assert tuple(results.read_analysis(spark, path, ERROR_PROFILE).first()) == row


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_models_are_saved_side_by_side(spark, fmt):
    path = new_path(spark, "models")
    names = "model_name string, idx long, score double"
    for model, rows in (("base", 3), ("round1", 2), ("base", 1)):
        results.write_result(spark.createDataFrame([(model, i, None) for i in range(rows)], names), path, fmt)
    found = spark.read.schema(names).format(fmt).load(path)
    assert sorted((r.model_name, r.idx) for r in found.collect()) == [("base", 0), ("round1", 0), ("round1", 1)]
    results.write_result(spark.createDataFrame([("base", 9, 1.0)], names), path, fmt, by_model=False)
    assert [tuple(r) for r in spark.read.schema(names).format(fmt).load(path).collect()] == [("base", 9, 1.0)]


def many_databases(spark, rows=20_010, databases=400):
    ddl = spark.range(databases).select(F.concat(F.lit("db"), F.col("id").cast("string")).alias("db_id"), F.repeat(F.lit("x"), 50).alias("ddl"))
    train = spark.range(rows).select(
        F.col("id").alias("idx"), F.concat(F.lit("db"), (F.col("id") % databases).cast("string")).alias("db_id"), F.lit("Q?").alias("question"), F.lit("SELECT 1").alias("query")
    )
    nothing = train.limit(0).selectExpr("*", "'' AS augmentation_type", "1 AS copy", "'' AS model_name", "'' AS category")
    return augmentation.training_mix(train, nothing), ddl


@pytest.mark.parametrize("max_bytes", [0, 1 << 23])
def test_a_mix_is_in_one_order_and_holds_nearly_all_databases_everywhere(spark, max_bytes):
    mix, ddl = many_databases(spark)
    made = augmentation.mixed_prompts(mix, ddl, partitions=8, max_bytes=max_bytes)
    path = new_path(spark, "mix")
    made.write.parquet(path)
    files = sorted({r.name for r in spark.read.parquet(path).select(F.col("_metadata.file_name").alias("name")).distinct().collect()})
    assert len(files) == 8
    order = []
    for name in files:
        rows = [(r.place, r.db_id) for r in spark.read.parquet(f"{path}/{name}").collect()]
        assert len({db for _, db in rows}) >= 395 and abs(len(rows) - 20_010 / 8) < 300
        order += [place for place, _ in rows]
    assert order == sorted(order) and len(set(order)) == 20_010
    # texts are moved only where they don't fit
    exchange = plan(made).index("Exchange") if max_bytes else None
    assert max_bytes == 0 or "BroadcastHashJoin" in plan(made)[:exchange]


def test_entry(spark):
    assert entry(spark).columns == ["model_name", "difficulty", "correct", "total", "accuracy"]


def test_stages_end_to_end(spark):
    predictions = inputs.predictions(spark, DATA)
    evaluation = stages.evaluate(predictions)
    columns = written(corpus.catalog_long(corpus.schema_catalog(inputs.schema_examples(spark, DATA))), "columns")
    analysis = stages.analyze(evaluation.scored, columns, [("base", "round1")])
    total = {r.model_name: r.total for r in evaluation.overall.collect()}
    assert {r.model_name: r.num_examples for r in evaluation.summary.collect()} == total
    assert evaluation.paired_tests.count() == 3 and analysis.shifts.count() == 6
    wrong = evaluation.scored.filter("NOT is_correct").count()
    assert analysis.classified.count() == wrong == sum(r["count"] for r in analysis.primary.collect())
    ddl = prompts.ddl_of_columns(columns)
    made = stages.augment(analysis, "round1", inputs.train(spark, DATA), ddl)
    totals = made.totals.first()
    assert totals.total_combined == made.mix.count() == totals.total_original + made.rows.count()
    # dealt by place and in its order over all partitions
    by_part = {}
    for r in made.mix.select("place", F.spark_partition_id().alias("part")).collect():
        by_part.setdefault(r.part, []).append(r.place)
    order = [place for _, places in sorted(by_part.items()) for place in places]
    assert order == sorted(order)
    assert len({p for places in by_part.values() for p in places}) == totals.total_combined
    assert "rangepartitioning" not in made.mix._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_plan_runs_python_or_a_cross_join(spark):
    for name in ("accuracy_by_difficulty", "classify_errors", "category_distribution", "running_accuracy", "augment"):
        text = plan(queries()[name](spark, DATA))
        assert not any(w in text for w in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin")), name


def test_classification_adds_no_shuffle(spark):
    text = plan(queries()["classify_errors"](spark, DATA))
    assert text.count("Exchange") == text.count("RoundRobinPartitioning")


def test_accuracy_reads_only_its_columns(spark):
    text = plan(queries()["accuracy_by_difficulty"](spark, DATA))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in text


def test_results_do_not_depend_on_partitions(spark):
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    seen = []
    try:
        for n in ("1", "17"):
            spark.conf.set(setting, n)
            seen.append(sorted(map(str, queries()["mcnemar_table"](spark, DATA).collect())))
    finally:
        spark.conf.set(setting, before)
    assert seen[0] == seen[1]


def corpus_folder(spark, names):
    """A corpus of three rows per split, each split a folder of part files or one file named as shards are."""
    root = new_path(spark, "small-corpus")
    for name in names:
        rows = spark.range(3).selectExpr(
            "'shop' AS db_id", f"concat('SELECT ', id, ' FROM {name}') AS query", f"concat('{name} ', id, '?') AS question",
            "array('a') AS query_toks", "array('a') AS query_toks_no_value", "array('a') AS question_toks",
        )
        rows.coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return f"{root}/*.parquet"


def test_any_split_is_loaded(spark):
    found = corpus.load_examples(spark, corpus_folder(spark, ["train", "test", "dev_2"])).collect()
    assert sorted({r.split for r in found}) == ["dev_2", "test", "train"]
    assert sorted((r.split, r.idx) for r in found) == [(s, i) for s in ("dev_2", "test", "train") for i in range(3)]


def test_prepare_honours_its_settings(spark):
    catalog = spark.createDataFrame([("shop", ["t"], [(-1, "*"), (0, "id")], ["text", "number"], [], [])], NESTED_CATALOG)
    shown = PromptSettings(with_types=False, with_foreign_keys=False, max_seq_length=None)
    made = stages.prepare(spark, corpus_folder(spark, ["train", "validation", "test"]), catalog, Settings(prompts=shown, train_subset=2))
    assert "number" not in made.ddl.first().ddl and "id" in made.ddl.first().ddl
    assert made.train.count() == 2 and made.evaluation.count() == made.questions.count() == 3
    assert made.prompts.count() == 2 and made.counts == {"examples": 2, "kept": 2, "dropped": 0}
    cut = stages.prepare(spark, corpus_folder(spark, ["train"]), catalog, Settings(validation_ratio=1.0))
    assert "number" in cut.ddl.first().ddl
    assert cut.train.count() == 0 and cut.evaluation.count() == 3
    assert cut.prompts.count() == 0 and cut.counts == {"examples": 0, "kept": 0, "dropped": 0}
    short = PromptSettings(max_seq_length=1)
    none = stages.prepare(spark, corpus_folder(spark, ["train", "validation"]), catalog, Settings(prompts=short))
    assert none.prompts.count() == 0 and none.counts == {"examples": 3, "kept": 0, "dropped": 3}
