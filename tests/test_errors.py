"""Classification, error tables and augmentation on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import rewrites
from sqlgauge.operators import augmentation, error_tables, taxonomy
from sqlgauge.session import lookup_join
from sqlgauge.settings import AugmentationSettings

SCHEMA = (
    "model_name string, idx long, db_id string, question string, gold_sql string, pred_sql string, "
    "difficulty string, is_correct boolean"
)
E1, E2, E3, E4, E5, E6 = taxonomy.CATEGORIES

CASES = [
    # predicted, gold, categories
    ("", "SELECT a FROM t", [E6]),
    (None, "SELECT a FROM t", [E6]),
    ("Sorry", "SELECT a FROM t", [E6]),
    ("CREATE TABLE t", "SELECT a FROM t", [E6]),
    ("selected", "SELECT a", [E1]),
    ("SELECT a FROM t", "SELECT b FROM t", [E1]),
    ("SELECT a FROM u", "SELECT a FROM t", [E1]),
    ("SELECT a FROM t JOIN u ON x", "SELECT a FROM t LEFT JOIN u ON x", [E2]),
    ("SELECT a FROM t JOIN u AS v ON x", "SELECT a FROM t, u JOIN u ON x", [E2]),
    ("SELECT sum(a) FROM t", "SELECT avg(a) FROM t", [E3]),
    ("SELECT a FROM t GROUP BY a, b", "SELECT a FROM t GROUP BY b, a", [E1]),
    ("SELECT a FROM t GROUP BY a", "SELECT a FROM t GROUP BY b", [E3]),
    ("SELECT a FROM t WHERE a = 1", "SELECT a FROM t WHERE a > 1", [E4]),
    ("SELECT a FROM t LIMIT 1", "SELECT a FROM t", [E4]),
    ("SELECT a FROM t", "SELECT a FROM t UNION SELECT a FROM t", [E5]),
    (
        "SELECT count(*) FROM t WHERE a = 1",
        "SELECT a FROM u JOIN v USING (x) WHERE a IN (SELECT b FROM w) LIMIT 3",
        [E1, E2, E3, E4, E5],
    ),
]


def frame(spark, cases, model="m", db="d", level="easy"):
    rows = [(model, i, db, f"Q{i}?", g, p, level, False) for i, (p, g, *_) in enumerate(cases)]
    return spark.createDataFrame(rows, SCHEMA)


def test_categories(spark):
    found = taxonomy.classify_errors(frame(spark, CASES)).orderBy("idx").collect()
    assert [r.categories for r in found] == [c for *_, c in CASES]
    assert [r.primary_category for r in found] == [c[0] for *_, c in CASES]
    assert [r.severity for r in found] == [3 if c == [E6] else min(len(c), 3) for *_, c in CASES]
    assert found[0].details.syntax.type == "empty_output" and found[2].details.syntax.type == "invalid_sql"
    assert found[2].details.syntax.description == "SQL failed to parse: Sorry..."
    assert found[5].details.fallback and found[6].details.fallback is None
    assert found[6].details.schema_linking.missing_tables == ["t"]
    assert found[7].details.join_errors.join_type_mismatch.gold == ["LEFT JOIN"]
    assert found[13].details.filter_condition.limit_mismatch.predicted_has_limit


def test_keeping_right_rows_changes_nothing_else(spark):
    rows = frame(spark, CASES)
    right = rows.withColumn("idx", F.col("idx") + 100).withColumn("is_correct", F.lit(True))
    both = taxonomy.classify_errors(rows.unionAll(right), keep_correct=True)
    plain = taxonomy.classify_errors(rows)
    assert sorted(map(str, both.filter("NOT is_correct").collect())) == sorted(map(str, plain.collect()))
    kept = both.filter("is_correct").orderBy("idx").collect()
    assert [r.pred_sql for r in kept] == [c[0] for c in CASES] and all(r.categories is None for r in kept)


def test_unknown_names_by_distinct_lists(spark):
    texts = [
        "SELECT a FROM t WHERE k = 1 AND Z = 2 AND a > 1",
        "SELECT a FROM t WHERE k = 1 AND a > 1",
        "SELECT a FROM t",
        "no query at all where q = 1",
        None,
    ]
    rows = [(i, db, "SELECT 1", texts[i % 5], i % 7 == 0, "m") for i in range(200) for db in ("one", "two", "none", None)]
    df = spark.createDataFrame(rows, "idx long, db_id string, gold_sql string, pred_sql string, is_correct boolean, model_name string")
    columns = spark.createDataFrame([("one", "a"), ("one", "Y"), ("two", "z"), ("two", "*"), ("gone", "a")], "db_id string, col_name string")
    wrong = df.filter("NOT is_correct")
    names = {(r.db_id, tuple(r._refs)): r._unknown for r in taxonomy.unknown_names(wrong.fillna("", ["pred_sql"]), columns).collect()}
    assert names == {("one", ("a", "z")): ["z"], ("two", ("a", "z")): ["a"], ("two", ("a",)): ["a"]}
    for keep_correct in (False, True):
        found = taxonomy.classify_errors(df, columns, keep_correct)
        assert found.columns == [*df.columns, "categories", "primary_category", "severity", "details"]
        got = {(r.idx, r.db_id): r for r in found.collect()}
        assert len(got) == (800 if keep_correct else wrong.count())
        for (i, db), r in got.items():
            refs = [("a", "z"), ("a",)][i % 5] if i % 5 < 2 else ()
            linking = r.details and r.details.schema_linking
            want = None if r.is_correct else names.get((db, refs))
            assert (linking and linking.hallucinated_columns) == want


def test_no_row_carries_the_columns_of_its_database(spark):
    rows = spark.createDataFrame([(0, "one", "SELECT 1", "SELECT a FROM t WHERE b = 1", False)], "idx long, db_id string, gold_sql string, pred_sql string, is_correct boolean")
    columns = spark.createDataFrame([("one", f"c{k}") for k in range(50)], "db_id string, col_name string")
    plan = taxonomy.classify_errors(rows, columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "col_name" not in plan


def test_unknown_columns_need_a_catalog_of_the_database(spark):
    pair = [("SELECT a FROM t WHERE x = 1 AND b = 1 AND c = 2", "SELECT a FROM t WHERE x = 1 AND b = 1")]
    rows = frame(spark, pair, db="known").unionAll(frame(spark, pair, db="other"))
    columns = spark.createDataFrame([("known", "B"), ("known", "*")], "db_id string, col_name string")
    found = {r.db_id: r.details.schema_linking for r in taxonomy.classify_errors(rows, columns).collect()}
    assert found["known"].hallucinated_columns == ["c"] and found["other"] is None


def profile(spark):
    rows = frame(spark, CASES).unionAll(frame(spark, CASES[:6], level=None))
    right = frame(spark, CASES[:10], model="perfect").withColumn("is_correct", F.lit(True))
    return error_tables.error_profile(taxonomy.classify_errors(rows.unionAll(right), keep_correct=True))


def test_distributions(spark):
    table = profile(spark)
    found = error_tables.category_distribution(table).collect()
    counts = {(r.model_name, r.category): r["count"] for r in found}
    everything = [c for *_, c in CASES + CASES[:6]]
    assert all(counts["m", c] == sum(c in cs for cs in everything) for c in taxonomy.CATEGORIES)
    assert all(r.pct_of_errors == 0 and r["count"] == 0 for r in found if r.model_name == "perfect")
    primary = {(r.model_name, r.category): r["count"] for r in error_tables.primary_distribution(table).collect()}
    assert sum(n for (m, _), n in primary.items() if m == "m") == len(everything)
    assert all(primary[k] <= n for k, n in counts.items())
    matrix = error_tables.difficulty_error_matrix(table).collect()
    assert {r.difficulty for r in matrix} == {"easy", "unknown"} and {r.model_name for r in matrix} == {"m"}
    for c in taxonomy.CATEGORIES:
        assert sum(r["count"] for r in matrix if r.category == c) == counts["m", c]
    ranked = error_tables.ranked_weaknesses(error_tables.category_distribution(table)).filter("model_name = 'perfect'")
    assert [r.category for r in ranked.orderBy("rank").collect()] == list(taxonomy.CATEGORIES)


def test_shift(spark):
    found = error_tables.distribution_shift(profile(spark), [("m", "perfect"), ("perfect", "m")]).collect()
    assert len(found) == 12
    forward = {r.category: r for r in found if r.model_before == "m"}
    assert forward[E1].direction == "improved" and forward[E1].accuracy_change == 1.0
    assert {r.direction for r in found if r.model_before == "perfect"} == {"worsened"}


def ranked(spark, rates):
    order = sorted(rates, key=lambda c: -rates[c])
    rows = [("m", c, float(rates[c]), i) for i, c in enumerate(order, 1)]
    return spark.createDataFrame(rows, "model_name string, category string, error_rate double, rank int")


@pytest.mark.parametrize(
    ("rates", "expected"),
    [
        ({E1: 50, E2: 15, E3: 14.9, E4: 60, E5: 0, E6: 20}, [E4, E1, E6]),
        ({E1: 50, E2: 1, E3: 2, E4: 3, E5: 0, E6: 4}, [E1]),
        ({E1: 5, E2: 1, E3: 2, E4: 3, E5: 0, E6: 4}, [E1, E6, E4]),
    ],
)
def test_weak_categories(spark, rates, expected):
    found = augmentation.weak_categories(ranked(spark, rates)).orderBy("rank")
    assert [r.category for r in found.collect()] == expected


TRAIN = "idx long, db_id string, question string, query string"


def test_related_rows_and_copies(spark):
    errors = taxonomy.classify_errors(frame(spark, CASES))
    weak = spark.createDataFrame([("m", E2), ("m", E3), ("m", E6)], "model_name string, category string")
    train = spark.createDataFrame(
        [(0, "d", "A?", "SELECT count(*) FROM t JOIN u ON x = y"), (1, "e", "B?", "SELECT 1"), (2, "d", "", "SELECT 1")],
        TRAIN,
    )
    databases = augmentation.error_databases(errors, weak)
    related = augmentation.related_examples(train, databases)
    assert sorted((r.category, r.idx) for r in related.collect()) == [(c, i) for c in (E2, E3, E6) for i in (0, 2)]
    made = augmentation.augment(related, AugmentationSettings(multiplier=2)).collect()
    kinds = sorted((r.augmentation_type, r.copy) for r in made)
    assert kinds == [(k, c) for k in ("E2_join_emphasis", "E2_join_path", "E3_agg_rephrase") for c in (1, 2)]
    shown = augmentation.error_sources(augmentation.error_examples(errors, weak))
    sources = related.select(*shown.columns).unionByName(shown)
    stats = {r.category: tuple(r)[2:] for r in augmentation.augmentation_stats(sources, augmentation.augment(sources)).collect()}
    assert stats == {E2: (2 + 3, 6), E3: (2 + 3, 3)}
    from_gold = augmentation.error_sources(augmentation.error_examples(errors, weak), gold_as_query=True)
    assert augmentation.augment(from_gold).count() > 0


def test_a_registered_rewrite_is_applied(spark):
    before = list(rewrites.RULES)
    try:
        rewrites.register(E6, "E6_plain", lambda question, query, draw: F.concat(question, F.lit(" SQL only.")))
        rows = spark.createDataFrame([(0, "d", "A?", "SELECT 1", E6)], TRAIN + ", category string")
        made = augmentation.augment(rows, AugmentationSettings(multiplier=1)).collect()
        assert [(r.augmentation_type, r.question) for r in made] == [("E6_plain", "A? SQL only.")]
    finally:
        rewrites.RULES[:] = before


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_broadcast(spark, how):
    rows = spark.range(3000).select(
        F.col("id").alias("idx"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3)], "k string, v int")
    a = lookup_join(rows, small, "k", spread=F.col("idx"), how=how)
    b = lookup_join(rows, small, "k", spread=F.col("idx"), how=how, max_bytes=0)
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_only_hot_keys_are_copied(spark):
    rows = spark.range(2000).select(F.col("id").alias("idx"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    small = spark.range(300).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") * 10)).alias("k"), F.col("id").alias("v"))
    from sqlgauge.session import SALTS, hot_keys

    assert [r.k for r in hot_keys(rows, ["k"]).collect()] == ["hot"]
    found = lookup_join(rows, small, "k", spread=F.col("idx"), max_bytes=0)
    assert found.count() == 2000 and found.filter("v = 0").count() == 1800
    copied = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode\(if \(_hot|Generate explode\(CASE WHEN _hot", copied), copied
    assert SALTS > 1
