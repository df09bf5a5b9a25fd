"""Column functions that describe the structure of a SQL text by pattern.

All are narrow: computing them inside the projection that needs them adds no shuffle, whatever share of
the rows repeats one text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlgauge.functions.text import MULTI_LINE, ONE_LINE, SPACE, WORD, any_of, every_match, first_letters, first_match, strip, with_value, words_in

_TABLE = rf"{ONE_LINE}{any_of(('FROM', 'JOIN'))}{SPACE}+({WORD}+)"
_JOIN_KINDS = ("LEFT", "RIGHT", "INNER", "OUTER", "CROSS", "NATURAL")
_JOIN = (
    rf"{ONE_LINE}(?={first_letters((*_JOIN_KINDS, 'JOIN'))})((?:(?:{'|'.join(_JOIN_KINDS)}){SPACE}*)?JOIN)"
    rf"{SPACE}+({WORD}+){SPACE}+(?:ON|USING)"
)
_AGGREGATE = rf"{ONE_LINE}({any_of(('COUNT', 'SUM', 'AVG', 'MIN', 'MAX'))}){SPACE}*\("


def _until(words: Sequence[str], breaks: str = "") -> str:
    """A group of one character or more that ends where one of the words stands, or with the text.

    It finds what ``(.+?)(?:words|$)`` does, without comparing the words at every character; a blank line end may be left at
    the end of the text. ``breaks`` is what a dot doesn't match.
    """
    first, listed = first_letters(words), "|".join(words)
    others = f"[^{first[1:-1]}{breaks}]*+"
    return rf"(.{others}(?:(?!{listed}){first}{others})*+)(?:{listed}|$)"


_GROUP_BY = rf"{ONE_LINE}GROUP{SPACE}+BY{SPACE}+{_until(('HAVING', 'ORDER', 'LIMIT'), r'\n')}"
_HAVING = rf"{ONE_LINE}HAVING{SPACE}+{_until(('ORDER', 'LIMIT'), r'\n')}"
_WHERE = rf"{MULTI_LINE}WHERE{SPACE}+{_until(('GROUP', 'ORDER', 'LIMIT', 'HAVING'))}"
# Only plain blanks may separate keyword and name here: other white space inside a condition blocks the match.
_CONDITION_NAME = rf"{ONE_LINE}(?:SELECT|ON|WHERE|AND|OR|BY) +({WORD}+)"

# Comparison operators looked for as substrings.
OPERATORS = (">=", "<=", "!=", "<>", "=", ">", "<", "LIKE", "BETWEEN", "IN", "NOT IN", "IS NOT", "IS")

# Words after a keyword that are not column names.
NOT_COLUMNS = (
    "DISTINCT", "ALL", "FROM", "AS", "AND", "OR", "NOT", "NULL",
    "TRUE", "FALSE", "SELECT", "WHERE", "JOIN", "ON", "IN",
    "EXISTS", "BETWEEN", "LIKE", "IS", "CASE", "WHEN", "THEN",
    "ELSE", "END", "ASC", "DESC", "LIMIT", "OFFSET",
)


def _all(sql: Column, pattern: str, group: int = 1) -> Column:
    return every_match(F.coalesce(sql, F.lit("")), pattern, group)


def _clause(sql: Column, keyword: str, pattern: str) -> Column:
    """Text of a clause, NULL without one. A clause pattern never matches the empty text.

    The keyword is looked for first: most texts lack most clauses, and a substring search costs little.
    """
    found = with_value(first_match(sql, pattern), lambda text: F.when(text != "", text))
    return F.when(F.contains(F.upper(sql), F.lit(keyword)), found)


def table_references(sql: Column) -> Column:
    """Names after FROM and JOIN as written, with repeats."""
    return _all(sql, _TABLE)


def sql_tables(sql: Column) -> Column:
    """Set of lower-case table names."""
    return F.sort_array(F.array_distinct(F.transform(table_references(sql), lambda t: F.lower(t))))


def _joins(sql: Column, group: int) -> Column:
    # most texts have no join at all, which a substring search tells sooner than the pattern
    has_join = F.contains(F.upper(sql), F.lit("JOIN"))
    return F.when(has_join, _all(sql, _JOIN, group)).otherwise(F.array().cast("array<string>"))


def join_types(sql: Column) -> Column:
    return _joins(sql, 1)


def join_tables(sql: Column) -> Column:
    return F.transform(_joins(sql, 2), lambda t: F.lower(t))


def sql_joins(sql: Column) -> Column:
    """(type, table) of every join that names its condition right after the table."""
    return F.zip_with(
        join_types(sql),
        join_tables(sql),
        lambda kind, table: F.struct(kind.alias("type"), table.alias("table")),
    )


def sql_aggregates(sql: Column) -> Column:
    return F.transform(_all(sql, _AGGREGATE), lambda a: F.upper(a))


def select_count(sql: Column) -> Column:
    return F.regexp_count(F.upper(F.coalesce(sql, F.lit(""))), F.lit("SELECT"))


def subquery_count(sql: Column) -> Column:
    return F.greatest(select_count(sql) - F.lit(1), F.lit(0))


def sql_group_by(sql: Column) -> Column:
    """Lower-case grouping expressions; an empty list without GROUP BY."""
    items = F.transform(F.split(strip(_clause(sql, "GROUP", _GROUP_BY)), ","), lambda c: F.lower(strip(c)))
    return F.coalesce(items, F.array().cast("array<string>"))


def sql_having(sql: Column) -> Column:
    return strip(_clause(sql, "HAVING", _HAVING))


def sql_where(sql: Column) -> Column:
    return strip(_clause(sql, "WHERE", _WHERE))


def sql_features(sql: Column) -> Column:
    """All parts in one struct."""
    return F.struct(
        sql_tables(sql).alias("tables"),
        sql_joins(sql).alias("joins"),
        sql_aggregates(sql).alias("aggregations"),
        sql_where(sql).alias("where_cond"),
        subquery_count(sql).alias("subquery_count"),
        sql_group_by(sql).alias("group_by"),
        sql_having(sql).alias("having"),
        (F.coalesce(sql, F.lit("")) != "").alias("is_valid"),
    )


def sql_operators(sql: Column) -> Column:
    """Which operators occur anywhere in the text, in list order."""
    return words_in(sql, OPERATORS)


def condition_column_refs(where_cond: Column, having: Column, group_by: Column) -> Column:
    """Set of lower-case names that follow a keyword inside the conditions and grouping of a query."""
    # the quote keeps a name at the end of one part from pairing with the start of the next
    texts = F.concat_ws("','", where_cond, F.array_join(group_by, "','"), having)
    names = F.filter(
        F.transform(with_value(texts, lambda t: _all(t, _CONDITION_NAME)), lambda c: F.struct(F.lower(c).alias("l"), F.upper(c).alias("u"))),
        lambda n: ~n["u"].isin(*NOT_COLUMNS),
    )
    return F.sort_array(F.array_distinct(F.transform(names, lambda n: n["l"])))
