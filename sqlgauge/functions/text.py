"""Column functions that clean and compare model output and SQL text.

Character classes are spelled out so that a word is a letter, digit or underscore of any script and a
blank is any Unicode space or the four ASCII separators; Java's own ``\\w`` and ``\\s`` differ in both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and the same set as a regular expression class.
NARROW_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
WIDE_SPACE = (
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITE_SPACE = NARROW_SPACE + WIDE_SPACE
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"

# what the two classes hold of ASCII
PLAIN_SPACE = r"[\t-\r\x1c-\x20]"
PLAIN_WORD = "[A-Za-z0-9_]"

# i: any case, u: of any script, d: only \n ends a line, s: the dot also matches \n
ONE_LINE = "(?iud)"
MULTI_LINE = "(?iuds)"

# Keywords a statement may open with, and openings of lines that are prose after the SQL.
STATEMENT_KEYWORDS = ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")
PROSE_OPENINGS = ("NOTE:", "EXPLANATION:", "THIS ", "THE ", "I ", "HERE")
_SENTENCE_OPENINGS = tuple(o for o in PROSE_OPENINGS if o.endswith(" "))

# Keywords whose presence is counted in corpus statistics.
CORPUS_KEYWORDS = (
    "JOIN", "GROUP BY", "ORDER BY", "HAVING", "UNION", "INTERSECT",
    "EXCEPT", "LIKE", "BETWEEN", "IN", "EXISTS", "NOT",
)

# Wording of comparison operators, applied in this order.
CONDITION_WORDING = (
    (" = ", " equals "),
    (" > ", " is greater than "),
    (" < ", " is less than "),
    (" >= ", " is at least "),
    (" <= ", " is at most "),
    (" != ", " is not "),
    (" AND ", " and "),
    (" OR ", " or "),
)


def first_letters(words: Sequence[str]) -> str:
    """The class of the letters that the words begin with."""
    return f"[{''.join(sorted({word[0] for word in words}))}]"


def any_of(words: Sequence[str]) -> str:
    """One of the words. They are compared only where the first letter of one stands, not at every character."""
    return f"{first_letters(words)}(?:{'|'.join(f'{word[1:]}(?<={word})' for word in words)})"


_FENCE = rf"{MULTI_LINE}```(?:sql)?{SPACE}*\n?(.*?)\n?```"
_STATEMENT = rf"{MULTI_LINE}{any_of(STATEMENT_KEYWORDS)}(?!{WORD}).*"
_ON_LINE = rf"[{SPACE}&&[^\n]]*"
# a line counts without the blanks at its end, so the words that end in one need another word behind them
_PROSE_TAIL = (
    rf"{MULTI_LINE}\n{_ON_LINE}(?:{'|'.join(o for o in PROSE_OPENINGS if o not in _SENTENCE_OPENINGS)}"
    rf"|(?:{'|'.join(_SENTENCE_OPENINGS)}){_ON_LINE}[^{SPACE}]).*"
)


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_pattern(pattern: str) -> str:
    """The same pattern for texts without wide characters: short classes, and letters of ASCII in any case."""
    found = pattern.replace(SPACE, PLAIN_SPACE).replace(WORD, PLAIN_WORD)
    return found.replace(ONE_LINE, "(?id)").replace(MULTI_LINE, "(?ids)")


def by_script(text: Column, pattern: str, use: Callable[[str], Column]) -> Column:
    """``use`` of a pattern, or of its plain form where the text has no wide character: a match costs a fraction there."""
    return F.when(F.octet_length(text) == F.length(text), use(plain_pattern(pattern))).otherwise(use(pattern))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return by_script(text, pattern, lambda p: F.regexp_extract(text, p, group))


def every_match(text: Column, pattern: str, group: int = 1) -> Column:
    return by_script(text, pattern, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(group)))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def drop_semicolons(text: Column) -> Column:
    return strip(F.rtrim(text, F.lit(";")))


def collapse_spaces(text: Column) -> Column:
    """Every run of white space as one blank.

    A class of characters below 256 is one table lookup; the wide blanks are made plain ones beforehand, in
    texts that have any wide character at all.
    """
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.translate(text, WIDE_SPACE, " " * len(WIDE_SPACE))
    )
    return F.regexp_replace(plain, f"[{NARROW_SPACE}]+", " ")


def _without_prose(statement: Column) -> Column:
    cut = by_script(statement, _PROSE_TAIL, lambda pattern: F.regexp_replace(statement, pattern, ""))
    return F.when(F.contains(statement, F.lit("\n")), strip(cut)).otherwise(statement)


def extract_sql(raw_output: Column) -> Column:
    """SQL text inside a model's raw output; '' when the output is missing or blank."""

    def from_text(text: Column) -> Column:
        bare = with_value(
            first_match(text, _STATEMENT, 0),
            lambda found: drop_semicolons(F.when(found == "", text).otherwise(_without_prose(found))),
        )
        has_fence = F.contains(text, F.lit("```")) & F.regexp_like(text, F.lit(_FENCE))
        return F.when(has_fence, strip(F.regexp_extract(text, _FENCE, 1))).otherwise(bare)

    return with_value(strip(F.coalesce(raw_output, F.lit(""))), from_text)


def normalize_sql(sql: Column) -> Column:
    """Lower-case text on one line without trailing semicolons, for comparison; NULL becomes ''."""
    one_line = F.trim(collapse_spaces(F.lower(F.coalesce(sql, F.lit("")))))
    return F.trim(F.rtrim(one_line, F.lit(";")))


def example_hash(db_id: Column, question: Column) -> Column:
    """Twelve hex digits that identify a question on a database."""
    return F.substring(F.md5(F.concat(db_id, F.lit("||"), question)), 1, 12)


def words_in(sql: Column, words: Sequence[str]) -> Column:
    """Which of the words occur anywhere in the upper-case text, in list order."""
    listed = F.array(*[F.lit(w) for w in words])
    upper = F.upper(F.coalesce(sql, F.lit("")))
    return with_value(upper, lambda text: F.filter(listed, lambda word: F.contains(text, word)))


def keyword_flags(sql: Column) -> Column:
    """Which of the corpus keywords occur anywhere in the text, in list order."""
    return words_in(sql, CORPUS_KEYWORDS)


def simplify_condition(condition: Column) -> Column:
    """A condition in plain words."""
    words = F.trim(collapse_spaces(condition))
    for operator, wording in CONDITION_WORDING:
        words = F.replace(words, F.lit(operator), F.lit(wording))
    return F.lower(words)


def keyed_uniform(seed: int, *parts: Column) -> Column:
    """Uniform number in [0, 1) that depends on the seed and the key only, not on row order."""
    key = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
