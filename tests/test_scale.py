"""What keeps the work of a query from growing faster than its input."""

import pytest
from pyspark.errors.exceptions import captured
from pyspark.sql import functions as F

from sqlgauge.functions import features, text
from sqlgauge.operators import augmentation, chunks, execution, taxonomy
from sqlgauge.session import spread
from sqlgauge.sources import corpus, databases
from sqlgauge.sources.databases import Databases
from tests.conftest import DATA
from workload import queries


def test_results_of_equal_types_are_made_texts_once(spark, tmp_path, monkeypatch):
    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    session = Databases(spark, {"d": {"t": f"{tmp_path}/t.parquet"}}).session("d")
    cells, made = execution._cell, []
    monkeypatch.setattr(execution, "_cell", lambda *a: made.append(a[1]) or cells(*a))
    rows = [{"database": "d", "statement": f"SELECT id FROM t WHERE id < {n}"} for n in range(8)]
    rows.append({"database": "d", "statement": "SELECT 'x' FROM t"})
    found = {r["statement"]: r["n_rows"] for r in execution._digest_rows(session, rows, 15).collect()}
    assert found == {r["statement"]: n for r, n in zip(rows, [0, 1, 2, 3, 4, 5, 5, 5, 1])}
    assert len(made) == 2


def test_a_catalog_is_not_broadcast(spark):
    errors = spark.createDataFrame([("d", "SELECT a FROM t WHERE b = 1 AND c = 2"), ("e", "SELECT a FROM t WHERE b = 1 AND c = 2")], "db_id string, pred_sql string")
    columns = spark.createDataFrame([("d", "a"), ("e", "c")], "db_id string, col_name string")
    found = taxonomy.unknown_names(errors, columns)
    assert [(r["db_id"], r["_unknown"]) for r in found.collect()] == [("d", ["c"])]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_scan_is_cut_by_rows(spark):
    df = spark.range(1000, numPartitions=8)
    assert spread(df, rows=10).rdd.getNumPartitions() == 100
    assert spread(df, rows=10).agg(F.sum("id")).first()[0] == 499500


def test_plain_patterns_find_the_same(spark):
    texts = ["select a from t1 join\tB_2 on x", "SELECT a FROM äö JOIN Ж on x", "FROM  a", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    wide = F.regexp_extract_all("sql", F.lit(features._TABLE), F.lit(1))
    rows = df.select(text.every_match(F.col("sql"), features._TABLE).alias("found"), wide.alias("wide")).collect()
    assert [r["found"] for r in rows] == [r["wide"] for r in rows]
    assert rows[0]["found"] == ["t1", "B_2"]


def test_rewrites_are_made_once_for_all_models(spark):
    train = spark.createDataFrame(
        [(1, "d", "Q?", "SELECT max(a) FROM t GROUP BY b"), (1, "d", "Q?", "SELECT max(a) FROM t GROUP BY b"), (2, "e", "R?", "SELECT a FROM u")],
        "idx long, db_id string, question string, query string",
    )
    databases = spark.createDataFrame(
        [("m", "d", ["E3_AGGREGATION", "E1_SCHEMA_LINKING"]), ("n", "d", ["E3_AGGREGATION"]), ("n", "e", ["E1_SCHEMA_LINKING"])],
        "model_name string, db_id string, weak array<string>",
    )
    shared = augmentation.related_by_category(train, databases)
    assert shared.count() == 5
    each = augmentation.augment(augmentation.related_examples(train, databases))
    found = augmentation.augment(shared)
    assert found.columns == each.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, each.collect()))
    assert each.count() > 0


def test_a_catalog_is_dealt_by_rows(spark):
    nested = "struct<table_idx:int,name:string>"
    rows = spark.range(100).select(
        F.col("id").alias("idx"), F.lit("train").alias("split"), F.when(F.col("id") % 9 > 0, F.lit("big")).alias("db_id"),
        F.array(F.lit("t")).alias("table_names"), F.array(F.struct(F.lit(0).alias("table_idx"), F.concat(F.lit("c"), "id").alias("name"))).cast(f"array<{nested}>").alias("columns"),
        F.array(F.lit("x")).alias("column_types"), F.lit(None).cast("array<struct<col:int,ref_col:int>>").alias("foreign_keys"), F.array(F.lit(0)).alias("primary_keys"),
    )
    found = corpus.schema_catalog(rows, rows=2)
    assert found.rdd.getNumPartitions() == 50
    assert {(r["db_id"], r["columns"][0]["name"]) for r in found.collect()} == {(None, "c0"), ("big", "c1")}


def test_a_task_of_a_scan_holds_few_rows(spark):
    df = spread(spark.range(20 << 14, numPartitions=1))
    assert df.rdd.getNumPartitions() >= 20
    assert max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) <= 17_000


def test_words_are_found_by_their_first_letters(spark):
    texts = [
        "SELECT a FROM t join u ON 1 Left\tJoin v USING (x) jrom w FOIN z", "select Count (a), MAX(b), avg(c), mum(d), sin(e) from t",
        "SELECT a FROM t WHERE GROUP x ORDER BY b", "where a = 'goal' and h > 1\n", "WHERE  \n", "WHERE\n", "a where b\nor c limıt 1 LIMIT 2",
        "GROUP BY a, b\n", "GROUP BY a\nHAVING b", "group by \n a having x > 0\n\n", "HAVING orders ORDER BY 1", "HAVING o\n", "ſELECT a FROM Ж", "", None,
    ]
    one, many, blank, word = text.ONE_LINE, text.MULTI_LINE, text.SPACE, text.WORD
    plainly = {
        features._TABLE: rf"{one}(?:FROM|JOIN){blank}+({word}+)",
        features._JOIN: rf"{one}((?:(?:LEFT|RIGHT|INNER|OUTER|CROSS|NATURAL){blank}*)?JOIN){blank}+({word}+){blank}+(?:ON|USING)",
        features._AGGREGATE: rf"{one}(COUNT|SUM|AVG|MIN|MAX){blank}*\(",
        features._GROUP_BY: rf"{one}GROUP{blank}+BY{blank}+(.+?)(?:HAVING|ORDER|LIMIT|$)",
        features._HAVING: rf"{one}HAVING{blank}+(.+?)(?:ORDER|LIMIT|$)",
        features._WHERE: rf"{many}WHERE{blank}+(.+?)(?:GROUP|ORDER|LIMIT|HAVING|$)",
    }
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    for quick, plain in plainly.items():
        assert quick != plain  # the words of a plain pattern are compared at every character
        for use in (lambda p: p, text.plain_pattern):
            each = [F.transform(F.regexp_extract_all("sql", F.lit(use(p)), F.lit(1)), text.strip) for p in (quick, plain)]
            rows = df.select(*[e.alias(n) for n, e in zip(("quick", "plain"), each)]).collect()
            assert [r["quick"] for r in rows] == [r["plain"] for r in rows]
            assert any(r["quick"] for r in rows)


def test_invalid_statements_cost_no_python_exception(spark, tmp_path, monkeypatch):
    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    session = Databases(spark, {"d": {"t": f"{tmp_path}/t.parquet"}}).session("d")
    bad = ["SELECT missing FROM t", "SELECT 1 FROM nowhere", "SELECT FROM WHERE", "SELECT nope(id) FROM t", "SELECT 1 AS a, 'é' FROM t GROUP BY 7", "SELECT ? FROM t"]
    known = []
    for text in bad:
        try:
            session.sql(text)
        except Exception as error:
            known.append(chunks.reason_of(error))
    assert len(known) == len(bad)
    rows = [{"database": "d", "statement": text} for text in [*bad, "SELECT id FROM t"]]
    monkeypatch.setattr(captured, "convert_exception", lambda e: pytest.fail("converted"))
    found = {r["statement"]: (r["success"], r["error"], r["n_rows"]) for r in execution._digest_rows(session, rows, 15).collect()}
    assert found == {**{text: (False, reason, None) for text, reason in zip(bad, known)}, "SELECT id FROM t": (True, None, 5)}


def test_statements_on_a_small_database_are_one_task(spark, tmp_path, monkeypatch):
    spark.range(50, numPartitions=3).write.parquet(f"{tmp_path}/t.parquet")
    texts = ["SELECT count(*) FROM t WHERE id > 3", "SELECT a.id % 7 FROM t a JOIN t b ON a.id = b.id", "SELECT max(id) FROM t GROUP BY id % 5"]
    counts, plans = [], []
    for bound in (databases.SMALL, 0):
        monkeypatch.setattr(databases, "SMALL", bound)
        session = Databases(spark, {"d": {"t": f"{tmp_path}/t.parquet"}}).session("d")
        found = execution._digest_rows(session, [{"database": "d", "statement": text} for text in texts], 15)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        counts.append({(r["statement"], r["n_rows"], r["digest"]) for r in found.collect()})
    assert counts[0] == counts[1] and {n for _, n, _ in counts[0]} == {1, 7, 5}
    assert "Exchange hash" not in plans[0] and "Exchange Single" not in plans[0] and "Exchange hash" in plans[1]


def test_places_are_moved_as_bytes(spark):
    mix = spark.range(200).select("id", F.md5(F.col("id").cast("string")).alias("place"))
    found = augmentation.dealt(mix, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "unhex(" in below and "hex(place" not in below.replace("unhex(", "")
    assert found.columns == ["id", "place"]
    assert [r.place for r in found.collect()] == sorted(r.place for r in mix.collect())


def test_rows_related_to_errors_are_classified_without_texts_in_store(spark, monkeypatch):
    stored, put = {}, queries.written
    monkeypatch.setattr(queries, "written", lambda df, name="stage": stored.update({name: df.columns}) or put(df, name))
    queries._related_to_errors(spark, DATA)
    assert stored["classified"] == ["model_name", "db_id", "difficulty", "is_correct", "categories", "primary_category"]
