"""Inputs of the registered queries, each derived from a whole table of the given data.

Every derivation is a projection of one table: constant lists are arrays picked by position, so no input
needs a join, and the rows grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.session import spread

# twelve query templates that are valid on the given tables
TEMPLATES = (
    "SELECT count(*) FROM nation",
    "SELECT r_name FROM region ORDER BY r_name LIMIT 3",
    "SELECT n_name FROM nation WHERE n_regionkey = 1",
    "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "SELECT c_mktsegment, avg(c_acctbal) FROM customer GROUP BY c_mktsegment",
    "SELECT c_mktsegment, max(c_acctbal) FROM customer GROUP BY c_mktsegment HAVING count(*) > 10",
    "SELECT s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey >= 2)",
    "SELECT p_brand, min(p_size) FROM part WHERE p_size BETWEEN 5 AND 20 GROUP BY p_brand",
    "SELECT T1.n_name FROM nation AS T1 JOIN supplier AS T2 ON T1.n_nationkey = T2.s_nationkey "
    "WHERE T2.s_acctbal > 1000",
    "SELECT n_name FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey "
    "JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < 0 OR r_name LIKE 'A%'",
    "SELECT n_name FROM nation WHERE n_regionkey != 0 EXCEPT SELECT n_name FROM nation WHERE n_nationkey > 20",
    "SELECT p_name FROM part\nWHERE p_size = 7\nORDER BY p_name",
)

# the given tables
GIVEN_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)

MODELS = (("base", 0, 2), ("round1", 1, 3), ("round2", 2, 5))

# tables of the schema catalog: name, columns as (name, type, is primary key)
CATALOG_TABLES = (
    ("region", (("r_regionkey", "number", True), ("r_name", "text", False))),
    ("nation", (("n_nationkey", "number", True), ("n_name", "text", False), ("n_regionkey", "number", False))),
    (
        "customer",
        (
            ("c_custkey", "number", True),
            ("c_name", "text", False),
            ("c_nationkey", "number", False),
            ("c_acctbal", "number", False),
            ("c_mktsegment", "text", False),
        ),
    ),
    (
        "supplier",
        (
            ("s_suppkey", "number", True),
            ("s_name", "text", False),
            ("s_nationkey", "number", False),
            ("s_acctbal", "number", False),
        ),
    ),
    (
        "part",
        (
            ("p_partkey", "number", True),
            ("p_name", "text", False),
            ("p_brand", "text", False),
            ("p_size", "number", False),
        ),
    ),
    (
        "orders",
        (
            ("o_orderkey", "number", True),
            ("o_custkey", "number", False),
            ("o_orderstatus", "text", False),
            ("o_orderdate", "time", False),
        ),
    ),
)
# (column, referenced column) by position among all columns, the wildcard being column 0; the last is broken
CATALOG_KEYS = ((5, 1), (8, 3), (13, 3), (20, 6), (20, 99))
SHORT_TYPES = 6


def catalog_columns() -> list[tuple[int, str, str, bool]]:
    """(table_idx, name, type, is_pk) of the wildcard and of every column."""
    rows = [(-1, "*", "text", False)]
    for t, (_, columns) in enumerate(CATALOG_TABLES):
        rows.extend((t, *column) for column in columns)
    return rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(items: tuple[str, ...], place: Column) -> Column:
    return F.get(F.array(*[F.lit(i) for i in items]), place.cast("int"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Raw outputs of three models for every order."""
    orders = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    models = F.array(
        *[F.struct(F.lit(n).alias("model_name"), F.lit(i).alias("mid"), F.lit(s).alias("skill")) for n, i, s in MODELS]
    )
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    skilled = (cust + key) % 7 < F.col("skill")
    wrong_place = (key + 1 + cust % 11) % 12
    rows = orders.select("*", F.inline(models)).select(
        "*",
        _pick(TEMPLATES, key % 12).alias("gold_sql"),
        _pick(TEMPLATES, F.when(skilled, key % 12).otherwise(wrong_place)).alias("sql"),
    )
    sql, form = F.col("sql"), key % 6
    raw = (
        F.when((key + F.col("mid")) % 37 == 0, "")
        .when((key + F.col("mid")) % 41 == 0, "Sorry, no answer.")
        .when(form == 1, F.concat(F.lit("```sql\n"), sql, F.lit("\n```")))
        .when(form == 2, F.concat(sql, F.lit(";")))
        .when(form == 3, F.concat(F.lit("Answer: "), sql, F.lit("\nNote: done")))
        .when(form == 4, F.concat(F.lit("  "), F.upper(sql), F.lit("  ")))
        .otherwise(sql)
    )
    priority = F.col("o_orderpriority")
    level = (
        F.when(priority == "1-URGENT", "easy")
        .when(priority == "2-HIGH", "medium")
        .when(priority == "3-MEDIUM", "hard")
        .when(priority == "4-NOT SPECIFIED", "extra")
    )
    return rows.select(
        "model_name",
        key.alias("idx"),
        F.concat(F.lit("db_"), (cust % 20).cast("string")).alias("db_id"),
        F.concat(F.lit("Question "), key.cast("string"), F.lit("?")).alias("question"),
        "gold_sql",
        raw.alias("raw_output"),
        level.alias("difficulty"),
    )


def train(spark: SparkSession, folder: str) -> DataFrame:
    """A question and query for every order; one in ten is validation."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey")).select(
        key.alias("idx"),
        F.when(key % 10 == 0, "validation").otherwise("train").alias("split"),
        F.concat(F.lit("db_"), (cust % 25).cast("string")).alias("db_id"),
        F.concat(F.lit("How is Order "), key.cast("string"), F.lit(" placed?")).alias("question"),
        _pick(TEMPLATES, (key + cust) % 12).alias("query"),
    )


def long_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as questions."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("idx"),
        F.concat(F.lit("db_"), (F.col("doc_id") % 25).cast("string")).alias("db_id"),
        F.col("text").alias("question"),
        _pick(TEMPLATES, F.col("doc_id") % 12).alias("query"),
    )


def schema_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Examples that carry the nested schema of their database: one database per customer.

    The schema leaves out every third table by customer and, on odd orders, ends its type list early.
    """
    columns = catalog_columns()
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def placed(t: int) -> Column:
        return F.when((cust + F.lit(t)) % 3 == 0, -1).otherwise(F.lit(t)).cast("int")

    nested = F.array(
        *[F.struct(placed(t).alias("table_idx"), F.lit(name).alias("name")) for t, name, _, _ in columns]
    )
    kinds = F.array(*[F.lit(kind) for _, _, kind, _ in columns])
    keys = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(r).alias("ref_col")) for c, r in CATALOG_KEYS])
    return table(spark, folder, "orders").select(
        key.alias("idx"),
        F.when(key % 10 == 0, "validation").otherwise("train").alias("split"),
        F.concat(F.lit("db_"), (cust + 5).cast("string")).alias("db_id"),
        F.array(*[F.lit(name) for name, _ in CATALOG_TABLES]).alias("table_names"),
        nested.alias("columns"),
        F.when(key % 2 == 0, kinds).otherwise(F.slice(kinds, 1, SHORT_TYPES)).alias("column_types"),
        keys.alias("foreign_keys"),
        F.array(*[F.lit(i) for i, column in enumerate(columns) if column[3]]).alias("primary_keys"),
    )


def paired_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over the labelled documents."""
    runs = F.array(
        F.struct(F.lit("quality").alias("model_name"), (F.col("quality") == 1).alias("is_correct")),
        F.struct(F.lit("toxic").alias("model_name"), (F.col("toxic") == 0).alias("is_correct")),
    )
    return table(spark, folder, "labels").select(F.col("doc_id").alias("idx"), F.inline(runs))


def chat_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as raw outputs, most of them without SQL."""
    turns = table(spark, folder, "conversations").filter(F.col("role") == "assistant")
    return turns.select("conv_id", "turn", F.col("text").alias("raw_output"))


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores whose positions interleave between the models."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("model_name"), F.col("event_id").alias("idx"), (F.col("value") > 10).alias("is_correct")
    )


# Texts that vary by order: {k} is its key, {c} its customer.
VARIED = (
    "SELECT T1.c_name, count(*) FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey "
    "WHERE T2.order_id > {k} GROUP BY T1.c_name, T1.c_key{c} HAVING count(*) > {c} ORDER BY T1.c_name",
    "select max(order_id),\n\tmin(x{k})\nfrom t{c}\nwhere a{k} like '%b%'\nand b not between 1 and {c}",
    "SELECT a FROM t1 WHERE a IN (SELECT b FROM t{c} WHERE c = {k} AND d NOT IN (SELECT e FROM t2)) ORDER BY a DESC LIMIT 5",
    "SELECT p{k}, avg( price ), SUM(q) FROM part LEFT JOIN lineitem ON l = {c} INNER JOIN orders USING (o) GROUP BY p1, p2 , p{k}",
    "SELECT count(DISTINCT x.a) FROM big_{k} AS x WHERE x.order_by >= {c} OR x.name IS NULL UNION SELECT 1 FROM b{c} WHERE z <> 'it''s'",
    "Order {k} of {c} has no query, select none from it",
    "SELECT name FROM grouped{c} WHERE id = {k} GROUP BY name LIMIT 3",
)


def varied_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A text for every order, nearly all of them distinct."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = F.replace(_pick(VARIED, key % len(VARIED)), F.lit("{k}"), key.cast("string"))
    return table(spark, folder, "orders").select(F.replace(text, F.lit("{c}"), cust.cast("string")).alias("sql"))
