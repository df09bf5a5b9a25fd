"""Sorts wrong predictions into six error categories.

Classification is one chain of projections over the wrong rows: no shuffle, except that with a catalog the different lists
of names in conditions are looked up beforehand, and the few that hold unknown names are joined back by the list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.functions import features as S
from sqlgauge.functions.text import strip
from sqlgauge.session import evaluated_once, lookup_join

# Categories in taxonomy order with their labels.
CATEGORIES = {
    "E1_SCHEMA_LINKING": "Schema Linking",
    "E2_JOIN_ERROR": "JOIN Errors",
    "E3_AGGREGATION": "Aggregation",
    "E4_FILTER_CONDITION": "Filter/Condition",
    "E5_NESTING_SUBQUERY": "Nesting/Subquery",
    "E6_SYNTAX_FORMAT": "Syntax/Format",
}

# Texts of error details, and the openings of a statement that can be analyzed.
EMPTY_OUTPUT = "Model produced empty or no SQL"
FAILED_TO_PARSE = "SQL failed to parse: "
FALLBACK = "No specific structural difference detected; likely subtle column/value selection error"
STATEMENT_OPENINGS = ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE")

_SYNTAX = list(CATEGORIES)[-1]
_STRUCTURAL = list(CATEGORIES)[:-1]

_PARTS = {
    "tables": S.sql_tables,
    "join_types": S.join_types,
    "join_tables": S.join_tables,
    "aggregates": S.sql_aggregates,
    "group_by": S.sql_group_by,
    "having": S.sql_having,
    "where": S.sql_where,
    "subqueries": S.subquery_count,
    "operators": S.sql_operators,
}


def syntax_error_type(pred_sql: Column) -> Column:
    """empty_output, invalid_sql or NULL."""
    text = strip(F.coalesce(pred_sql, F.lit("")))
    opens = F.regexp_like(text, F.lit(rf"(?iu)\A(?:{'|'.join(STATEMENT_OPENINGS)})"))
    return F.when(text == "", "empty_output").when(~opens, "invalid_sql")


def _describe_syntax(kind: Column, pred_sql: Column) -> Column:
    shown = F.concat(F.lit(FAILED_TO_PARSE), F.substring(pred_sql, 1, 100), F.lit("..."))
    text = F.when(kind == "empty_output", EMPTY_OUTPUT).otherwise(shown)
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), text.alias("description")))


def _with_parts(errors: DataFrame) -> DataFrame:
    """Adds the syntax verdict and both texts' parts; the parts are computed for analyzable rows only."""
    errors = errors.withColumn("_syntax", syntax_error_type(F.col("pred_sql")))
    analyzable = F.col("_syntax").isNull()
    return errors.select(
        "*",
        *[
            F.when(analyzable, part(F.col(f"{side}_sql"))).alias(f"_{side}_{name}")
            for side in ("pred", "gold")
            for name, part in _PARTS.items()
        ],
    )


def _p(name: str) -> Column:
    return F.col(f"_pred_{name}")


def _g(name: str) -> Column:
    return F.col(f"_gold_{name}")


def _some(items: Column) -> Column:
    """The list, or NULL when it is empty."""
    return F.when(F.size(items) > 0, items)


def _pair(predicted: Column, gold: Column, names: tuple[str, str] = ("predicted", "gold")) -> Column:
    return F.struct(predicted.alias(names[0]), gold.alias(names[1]))


def _presence(clause: str, predicted: Column, gold: Column) -> Column:
    return _pair(predicted, gold, (f"predicted_has_{clause}", f"gold_has_{clause}"))


def _with_differences(parts: DataFrame, with_columns: bool) -> DataFrame:
    """Adds every difference of the five structural checks as one nullable column each."""
    p_where, g_where = _p("where").isNotNull(), _g("where").isNotNull()
    p_having, g_having = _p("having").isNotNull(), _g("having").isNotNull()
    p_groups, g_groups = F.size(_p("group_by")) > 0, F.size(_g("group_by")) > 0
    p_limit = F.contains(F.upper("pred_sql"), F.lit("LIMIT"))
    g_limit = F.contains(F.upper(F.coalesce("gold_sql", F.lit(""))), F.lit("LIMIT"))
    types = F.transform(_p("join_types"), lambda t: F.upper(t))
    gold_types = F.transform(_g("join_types"), lambda t: F.upper(t))
    hallucinated = F.col("_unknown") if with_columns else F.lit(None).cast("array<string>")

    analyzable = F.col("_syntax").isNull()
    differences = {
        "missing_tables": _some(F.array_except(_g("tables"), _p("tables"))),
        "extra_tables": _some(F.array_except(_p("tables"), _g("tables"))),
        "hallucinated_columns": hallucinated,
        "join_count_mismatch": F.when(
            F.size(_p("join_types")) != F.size(_g("join_types")),
            _pair(F.size(_p("join_types")), F.size(_g("join_types"))),
        ),
        "join_type_mismatch": F.when(
            F.sort_array(types) != F.sort_array(gold_types), _pair(types, gold_types)
        ),
        "missing_join_tables": _some(F.sort_array(F.array_except(_g("join_tables"), _p("join_tables")))),
        "extra_join_tables": _some(F.sort_array(F.array_except(_p("join_tables"), _g("join_tables")))),
        "aggregation_mismatch": F.when(
            F.sort_array(_p("aggregates")) != F.sort_array(_g("aggregates")),
            _pair(F.sort_array(_p("aggregates")), F.sort_array(_g("aggregates"))),
        ),
        "group_by_presence": F.when(p_groups != g_groups, _presence("group_by", p_groups, g_groups)),
        "group_by_columns": F.when(
            (p_groups == g_groups) & (F.sort_array(_p("group_by")) != F.sort_array(_g("group_by"))),
            _pair(_p("group_by"), _g("group_by")),
        ),
        "having_presence": F.when(p_having != g_having, _presence("having", p_having, g_having)),
        "where_presence": F.when(p_where != g_where, _presence("where", p_where, g_where)),
        "operator_mismatch": F.when(
            p_where & g_where & (_p("operators") != _g("operators")), _pair(_p("operators"), _g("operators"))
        ),
        "limit_mismatch": F.when(p_limit != g_limit, _presence("limit", p_limit, g_limit)),
        "subquery_count_mismatch": F.when(
            _p("subqueries") != _g("subqueries"), _pair(_p("subqueries"), _g("subqueries"))
        ),
    }
    assert list(differences) == [d for group in _CHECKS.values() for d in group]
    return evaluated_once(parts, **{f"_{name}": F.when(analyzable, d) for name, d in differences.items()})


# the differences each detail group holds, in category order
_CHECKS = {
    "schema_linking": ("missing_tables", "extra_tables", "hallucinated_columns"),
    "join_errors": ("join_count_mismatch", "join_type_mismatch", "missing_join_tables", "extra_join_tables"),
    "aggregation": ("aggregation_mismatch", "group_by_presence", "group_by_columns", "having_presence"),
    "filter_condition": ("where_presence", "operator_mismatch", "limit_mismatch"),
    "nesting": ("subquery_count_mismatch",),
}


def _refs(where: Column, having: Column, group_by: Column) -> Column:
    """The names in the conditions of an analyzable prediction."""
    return F.when(F.col("_syntax").isNull(), S.condition_column_refs(where, having, group_by))


def unknown_names(errors: DataFrame, columns: DataFrame) -> DataFrame:
    """The names in conditions that a database doesn't have: (db_id, _refs, _unknown), for each list with such names.

    ``errors`` are wrong rows, ``columns`` a long catalog. Only the distinct lists of names of each database are compared with
    the catalog, name by name; databases without catalog rows are left out. No row carries a database's columns.
    Catalogs repeat themselves and shrink on disk to far less than they take in memory, so they are merged, not broadcast.
    """
    pred = F.col("pred_sql")
    named = errors.select("db_id", syntax_error_type(pred).alias("_syntax"), pred)
    clauses = named.select("db_id", "_syntax", S.sql_where(pred).alias("_where"), S.sql_having(pred).alias("_having"), S.sql_group_by(pred).alias("_group"))
    lists = evaluated_once(clauses, _refs=_refs(F.col("_where"), F.col("_having"), F.col("_group"))).select("db_id", "_refs")
    lists = lists.filter(F.size("_refs") > 0).distinct()
    names = columns.filter(F.col("col_name") != "*").select("db_id", F.lower("col_name").alias("_name")).distinct()
    each = lists.join(names.select("db_id").distinct().hint("merge"), "db_id", "left_semi").select("db_id", "_refs", F.posexplode("_refs").alias("_at", "_name"))
    missing = each.join(names.hint("merge"), ["db_id", "_name"], "left_anti").groupBy("db_id", "_refs")
    found = missing.agg(F.array_sort(F.collect_list(F.struct("_at", "_name"))).alias("_found"))
    return found.select("db_id", "_refs", F.transform("_found", lambda x: x["_name"]).alias("_unknown"))


def classify_errors(
    scored: DataFrame, columns: DataFrame | None = None, keep_correct: bool = False
) -> DataFrame:
    """Adds categories, primary category, severity and details to the wrong predictions.

    ``columns`` is a long catalog; with it, names in conditions that the database does not have count as
    schema linking errors. A database without catalog rows is not checked. ``keep_correct`` leaves right
    predictions in, with NULL in the added columns.
    """
    base = scored.columns
    wrong = ~F.col("is_correct")
    errors = scored if keep_correct else scored.filter(wrong)
    # right rows pass through the same projections with both texts blanked, which makes them cheap
    texts = {c: F.when(wrong, F.coalesce(c, F.lit(""))) for c in ("pred_sql", "gold_sql")}
    errors = errors.select("*", *[F.col(c).alias(f"_kept_{c}") for c in texts]).withColumns(texts)

    parts = _with_parts(errors)
    if columns is not None:
        parts = parts.withColumn("_refs", _refs(_p("where"), _p("having"), _p("group_by")))
        unknown = unknown_names(scored.filter(wrong).withColumn("pred_sql", F.coalesce("pred_sql", F.lit(""))), columns)
        parts = lookup_join(parts, unknown, ["db_id", "_refs"], spread=F.col("idx"))
    found = _with_differences(parts, columns is not None)
    flags = {
        group: reduce(lambda a, b: a | b, [F.col(f"_{d}").isNotNull() for d in names])
        for group, names in _CHECKS.items()
    }
    structural = F.array_compact(
        F.array(*[F.when(flag, F.lit(c)) for c, flag in zip(_STRUCTURAL, flags.values())])
    )
    found = found.withColumn("_structural", structural)
    is_syntax = F.col("_syntax").isNotNull()
    categories = (
        F.when(is_syntax, F.array(F.lit(_SYNTAX)))
        .when(F.size("_structural") > 0, F.col("_structural"))
        .otherwise(F.array(F.lit(_STRUCTURAL[0])))
    )
    details = F.struct(
        _describe_syntax(F.col("_syntax"), F.col("pred_sql")).alias("syntax"),
        *[
            F.when(flags[group], F.struct(*[F.col(f"_{d}").alias(d) for d in names])).alias(group)
            for group, names in _CHECKS.items()
        ],
        F.when(~is_syntax & (F.size("_structural") == 0), FALLBACK).alias("fallback"),
    )
    added = {
        "categories": categories,
        "primary_category": F.element_at(categories, 1),
        "severity": F.when(is_syntax, 3).otherwise(F.least(F.size(categories), F.lit(3))),
        "details": details,
    }
    original = [F.col(f"_kept_{c}").alias(c) if c in texts else F.col(c) for c in base]
    return found.select(*original, *[F.when(wrong, c).alias(n) for n, c in added.items()])
