"""Hand-worked edge rows of the text functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import features as S
from sqlgauge.functions import rewrites as R
from sqlgauge.functions import text as X


def run(spark, values, *functions):
    """Rows of the functions' results for each value, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    found = rows.select("i", *[f(F.col("v")).alias(f"f{n}") for n, f in enumerate(functions)]).orderBy("i")
    return [tuple(r)[1:] if len(functions) > 1 else r[1] for r in found.collect()]


EXTRACTION = [
    (None, ""),
    ("", ""),
    (" \n\t  \x1c", ""),
    ("```\nSELECT 1\n```", "SELECT 1"),
    ("```sql\nSELECT 1;\n```", "SELECT 1;"),
    ("```SQL SELECT 1```", "SELECT 1"),
    ("Text\n```sql\nSELECT a\nFROM b\n```\nmore ```x```", "SELECT a\nFROM b"),
    ("``````", ""),
    ("```sql\nSELECT 1", "SELECT 1"),
    ("SELECT 1\nThe answer is one", "SELECT 1"),
    ("SELECT 1\n\n   Note: done", "SELECT 1"),
    ("SELECT a\n\nFROM t;;\n  ", "SELECT a\n\nFROM t"),
    ("SELECT 1 ; ;", "SELECT 1 ;"),
    ("SELECT 1\nThen x", "SELECT 1\nThen x"),
    ("SELECT 1\nTherefore x", "SELECT 1\nTherefore x"),
    ("SELECT 1\nhereafter", "SELECT 1"),
    ("SELECT 1\nI think", "SELECT 1"),
    ("SELECT 1\nI", "SELECT 1\nI"),
    ("preSELECT x", "SELECT x"),
    ("I go with you", "with you"),
    ("selections only", "selections only"),
    ("withé SELECT 1", "SELECT 1"),
    ("no query here;;", "no query here"),
    ("The\nThe answer;", "The\nThe answer"),
    ("drop\tit", "drop\tit"),
    ("SELECT 1\r\nNote: x", "SELECT 1"),
    ("answer: select", "select"),
]


def test_extract_sql(spark):
    assert run(spark, [raw for raw, _ in EXTRACTION], X.extract_sql) == [sql for _, sql in EXTRACTION]


def test_normalize_sql(spark):
    given = [None, "", "  SELECT\n\t1 ;; ", "a   b", "a\x1cb", "a ; ;", ";", "ÀB", "x　"]
    assert run(spark, given, X.normalize_sql) == ["", "", "select 1", "a b", "a b", "a ;", "", "àb", "x"]


def test_strip_is_python_strip(spark):
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert sorted(blanks) == sorted(X.WHITE_SPACE)
    given = [b + "a" + b + "b" + b for b in blanks] + ["​a​", "\x00a"]
    assert run(spark, given, X.strip) == [g.strip() for g in given]


def test_example_hash(spark):
    found = spark.range(1).select(X.example_hash(F.lit("db"), F.lit("Wie viele? é"))).first()[0]
    assert found == hashlib.md5("db||Wie viele? é".encode()).hexdigest()[:12]


def test_tables_and_joins(spark):
    given = [
        "select * from A join a on x join B using (y) FROM\n  c",
        "SELECT * FROM t1 LEFT OUTER JOIN t ON a = b",
        "SELECT * FROM t1 LEFT  JOIN T on a = b NATURAL JOIN u USING (x)",
        "SELECT * FROM t JOIN u AS x ON a = b",
        "SELECT * FROM été JOIN naïf ON a",
        None,
    ]
    joins = lambda c: F.transform(S.sql_joins(c), lambda j: F.concat_ws(":", j["type"], j["table"]))
    assert run(spark, given, S.sql_tables, joins) == [
        (["a", "b", "c"], ["join:a", "join:b"]),
        (["t", "t1"], ["OUTER JOIN:t"]),
        (["t", "t1", "u"], ["LEFT  JOIN:t", "NATURAL JOIN:u"]),
        (["t", "u"], []),
        (["naïf", "été"], ["JOIN:naïf"]),
        ([], []),
    ]


def test_aggregates_and_subqueries(spark):
    given = ["SELECT count (*), Max(x), COUNT(y) FROM t", "SELECT a UNION SELECT b, selected", "x", ""]
    assert run(spark, given, S.sql_aggregates, S.subquery_count) == [
        (["COUNT", "MAX", "COUNT"], 0),
        ([], 2),
        ([], 0),
        ([], 0),
    ]


def test_clauses(spark):
    given = [
        "SELECT a FROM t WHERE a = 1 ORDER BY b",
        "SELECT a FROM t WHERE t.order_id = 3",
        "SELECT a FROM t\nWHERE x = 1\nAND y = 2",
        "SELECT a GROUP BY A , b HAVING count(*) > 1 LIMIT 2",
        "SELECT a GROUP BY a,\n b",
        "SELECT a GROUP BY a\n",
        "SELECT a GROUP BY  HAVING x",
        "SELECT a",
    ]
    assert run(spark, given, S.sql_where, S.sql_group_by, S.sql_having) == [
        ("a = 1", [], None),
        ("t.", [], None),
        ("x = 1\nAND y = 2", [], None),
        (None, ["a", "b"], "count(*) > 1"),
        (None, [], None),
        (None, ["a"], None),
        (None, ["having x"], "x"),
        (None, [], None),
    ]


def test_operators_and_keywords(spark):
    given = ["SELECT min(x) FROM t WHERE a >= 1", "a not in (1) and b is not null", ""]
    assert run(spark, given, S.sql_operators, X.keyword_flags) == [
        ([">=", "=", ">", "IN"], ["IN"]),
        (["IN", "NOT IN", "IS NOT", "IS"], ["IN", "NOT"]),
        ([], []),
    ]


def test_condition_column_refs(spark):
    refs = lambda c: S.condition_column_refs(S.sql_where(c), S.sql_having(c), S.sql_group_by(c))
    given = [
        "SELECT z FROM t WHERE a = 1 AND b = 2 or C > 3",
        "SELECT z FROM t WHERE a = 1 AND\nb = 2 AND\tc = 3",
        "SELECT z FROM t WHERE a IN (SELECT q FROM u WHERE r = 1) AND NOT x",
        "SELECT z FROM t WHERE color = 1 GROUP BY a, b",
        "SELECT z FROM t",
    ]
    assert run(spark, given, refs) == [["b", "c"], [], ["q", "r"], [], []]


def test_simplify_condition(spark):
    given = ["A = 1 AND  b >= 2\nOR c != 'X'", "a=1 and b", None]
    assert run(spark, given, X.simplify_condition) == [
        "a equals 1 and b is at least 2 or c is not 'x'",
        "a=1 and b",
        None,
    ]


SQL = {
    "two joins": "SELECT T1.a, b FROM x AS T1 JOIN y ON T1.i = y.i JOIN z ON y.j = z.j WHERE b > 3 ORDER BY b",
    "nested": "SELECT avg(a) FROM x WHERE a IN (SELECT min(a) FROM y GROUP BY c HAVING c = 1)",
    "flat": "SELECT a FROM x",
}


@pytest.mark.parametrize(
    ("rule", "sql", "expected"),
    [
        ("E1_column_hint", "two joins", "Which One (using tables: x, y, z)?"),
        ("E1_column_hint", "flat", "Which One (using table: x)?"),
        ("E1_table_context", "two joins", "Considering columns like a, i, j, which one.?"),
        ("E2_join_path", "two joins", "Which One.? (connecting through y)"),
        ("E2_join_path", "flat", None),
        ("E2_join_emphasis", "two joins", "By joining the relevant tables, which one.?"),
        ("E3_agg_rephrase", "nested", "Find the mean — Which One.?"),
        ("E3_agg_rephrase", "flat", None),
        ("E3_group_by_emphasis", "nested", "Group the results and which one.?"),
        (
            "E4_condition_explicit",
            "nested",
            "Which One.? (with the condition that a in (select min(a) from y)",
        ),
        ("E4_comparison_emphasis", "two joins", "With appropriate comparisons, which one.?"),
        ("E4_comparison_emphasis", "nested", None),
        ("E5_subquery_hint", "nested", "Using a subquery approach, which one.?"),
        ("E5_decomposition", "nested", "First identify the relevant subset, then which one.?"),
        ("E5_decomposition", "two joins", None),
    ],
)
def test_rewrites(spark, rule, sql, expected):
    rewrite = next(r.rewrite for r in R.RULES if r.name == rule)
    found = spark.range(1).select(rewrite(F.lit("Which One.?"), F.lit(SQL[sql]), F.lit(0.6))).first()[0]
    assert found == expected


@pytest.mark.parametrize(
    ("raw", "sql"),
    [
        ("SELECT 1\nTHIS \nx", "SELECT 1\nTHIS \nx"),
        ("SELECT 1\nI \nx", "SELECT 1\nI \nx"),
        ("SELECT 1\n  the rows", "SELECT 1"),
        ("SELECT 1\nThis  is it\nx", "SELECT 1"),
        ("SELECT 1\nThere", "SELECT 1\nThere"),
    ],
)
def test_prose_needs_a_word_on_its_line(spark, raw, sql):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(X.extract_sql(F.col("raw"))).first()[0] == sql
