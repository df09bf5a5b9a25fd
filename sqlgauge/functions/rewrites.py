"""Question rewrites aimed at one error category each.

A rewrite maps (question, query, draw) to a new question, or NULL where it does not apply. ``draw`` is a
uniform number of the row for rewrites that choose a wording. A user adds a rewrite with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlgauge.functions import features as S
from sqlgauge.functions.text import MULTI_LINE, ONE_LINE, SPACE, WORD, every_match, first_match, simplify_condition, with_value

_KEY_COLUMN = rf"{ONE_LINE}(?:SELECT|WHERE|ON|BY){SPACE}+(?:{WORD}+\.)?({WORD}+)"
_JOIN_PATH = (
    rf"{MULTI_LINE}JOIN{SPACE}+({WORD}+){SPACE}+.*?ON{SPACE}+.*?(?:JOIN|WHERE|GROUP|ORDER|LIMIT|$)"
)
_FILTER = rf"{MULTI_LINE}WHERE{SPACE}+(.+?)(?:GROUP|ORDER|LIMIT|$)"
_FIRST_AGGREGATE = rf"{ONE_LINE}(COUNT|SUM|AVG|MAX|MIN){SPACE}*\("

# Wordings of each aggregate function.
AGGREGATE_WORDING = {
    "COUNT": ("total number of", "how many"),
    "SUM": ("total", "sum of"),
    "AVG": ("average", "mean"),
    "MAX": ("maximum", "highest", "largest"),
    "MIN": ("minimum", "lowest", "smallest"),
}

Rewrite = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class RewriteRule:
    category: str
    name: str
    rewrite: Rewrite
    uses_draw: bool = False


def _upper_has(query: Column, word: str) -> Column:
    return F.contains(F.upper(query), F.lit(word))


def column_hint(question: Column, query: Column, draw: Column) -> Column:
    stem = F.rtrim(F.rtrim(question, F.lit("?")), F.lit("."))

    def hint(names: Column) -> Column:
        noun = F.when(F.size(names) > 1, " (using tables: ").otherwise(" (using table: ")
        return F.when(F.size(names) > 0, F.concat(stem, noun, F.array_join(names, ", "), F.lit(")?")))

    return with_value(S.table_references(query), hint)


def table_context(question: Column, query: Column, draw: Column) -> Column:
    def context(names: Column) -> Column:
        listed = F.array_join(F.slice(names, 1, 3), ", ")
        return F.when(
            F.size(names) > 0,
            F.concat(F.lit("Considering columns like "), listed, F.lit(", "), F.lower(question)),
        )

    return with_value(F.array_distinct(every_match(query, _KEY_COLUMN)), context)


def join_path(question: Column, query: Column, draw: Column) -> Column:
    def path(tables: Column) -> Column:
        through = F.array_join(tables, " through ")
        return F.when(F.size(tables) > 0, F.concat(question, F.lit(" (connecting through "), through, F.lit(")")))

    return with_value(every_match(query, _JOIN_PATH), path)


def join_emphasis(question: Column, query: Column, draw: Column) -> Column:
    return F.when(
        _upper_has(query, "JOIN"),
        F.concat(F.lit("By joining the relevant tables, "), F.lower(question)),
    )


def aggregate_rephrase(question: Column, query: Column, draw: Column) -> Column:
    def wording(first: Column) -> Column:
        phrase = F.lit(None).cast("string")
        for name, wordings in AGGREGATE_WORDING.items():
            choice = F.element_at(
                F.array(*[F.lit(w) for w in wordings]),
                F.floor(draw * F.lit(len(wordings))).cast("int") + F.lit(1),
            )
            phrase = F.when(first == name, choice).otherwise(phrase)
        return F.concat(F.lit("Find the "), phrase, F.lit(" — "), question)

    return with_value(F.upper(first_match(query, _FIRST_AGGREGATE)), wording)


def group_by_emphasis(question: Column, query: Column, draw: Column) -> Column:
    return F.when(
        _upper_has(query, "GROUP BY"), F.concat(F.lit("Group the results and "), F.lower(question))
    )


def condition_explicit(question: Column, query: Column, draw: Column) -> Column:
    return with_value(
        first_match(query, _FILTER),
        lambda condition: F.when(
            condition != "",
            F.concat(question, F.lit(" (with the condition that "), simplify_condition(condition), F.lit(")")),
        ),
    )


def comparison_emphasis(question: Column, query: Column, draw: Column) -> Column:
    return F.when(
        query.rlike(r"[<>]|!="),
        F.concat(F.lit("With appropriate comparisons, "), F.lower(question)),
    )


def subquery_hint(question: Column, query: Column, draw: Column) -> Column:
    return F.when(
        S.select_count(query) > 1,
        F.concat(F.lit("Using a subquery approach, "), F.lower(question)),
    )


def decomposition(question: Column, query: Column, draw: Column) -> Column:
    member = _upper_has(query, "IN") | _upper_has(query, "EXISTS")
    return F.when(
        (S.select_count(query) > 1) & member,
        F.concat(F.lit("First identify the relevant subset, then "), F.lower(question)),
    )


# Category and type tag of each rewrite, in the order they are applied.
RULES: list[RewriteRule] = [
    RewriteRule("E1_SCHEMA_LINKING", "E1_column_hint", column_hint),
    RewriteRule("E1_SCHEMA_LINKING", "E1_table_context", table_context),
    RewriteRule("E2_JOIN_ERROR", "E2_join_path", join_path),
    RewriteRule("E2_JOIN_ERROR", "E2_join_emphasis", join_emphasis),
    RewriteRule("E3_AGGREGATION", "E3_agg_rephrase", aggregate_rephrase, uses_draw=True),
    RewriteRule("E3_AGGREGATION", "E3_group_by_emphasis", group_by_emphasis),
    RewriteRule("E4_FILTER_CONDITION", "E4_condition_explicit", condition_explicit),
    RewriteRule("E4_FILTER_CONDITION", "E4_comparison_emphasis", comparison_emphasis),
    RewriteRule("E5_NESTING_SUBQUERY", "E5_subquery_hint", subquery_hint),
    RewriteRule("E5_NESTING_SUBQUERY", "E5_decomposition", decomposition),
]


def register(category: str, name: str, rewrite: Rewrite, uses_draw: bool = False) -> None:
    """Adds a rewrite for a category to those ``augment`` applies."""
    RULES.append(RewriteRule(category, name, rewrite, uses_draw))
