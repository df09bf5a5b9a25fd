"""The registered queries as DuckDB SQL over the same tables.

The plans are their own; word lists and wordings are shared with the library and are held to literals in the tests.
"""

from __future__ import annotations

import math

from sqlgauge.functions.features import NOT_COLUMNS, OPERATORS
from sqlgauge.functions.rewrites import AGGREGATE_WORDING
from sqlgauge.functions.text import CONDITION_WORDING, CORPUS_KEYWORDS, WHITE_SPACE
from sqlgauge.operators.taxonomy import CATEGORIES, FALLBACK
from sqlgauge.settings import SYSTEM_PROMPT
from workload.inputs import (
    CATALOG_KEYS,
    CATALOG_TABLES,
    GIVEN_TABLES,
    MODELS,
    SHORT_TYPES,
    TEMPLATES,
    VARIED,
    catalog_columns,
)


def q(text: str) -> str:
    """A string literal; blanks other than the plain one are written by code."""
    parts, plain = [], ""
    for c in text:
        if c.isspace() and c != " ":
            parts += [f"'{plain}'"] if plain else []
            parts.append(f"chr({ord(c)})")
            plain = ""
        else:
            plain += "''" if c == "'" else c
    if plain or not parts:
        parts.append(f"'{plain}'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


WS = q(WHITE_SPACE)
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def normalize(x: str) -> str:
    return f"trim(rtrim(trim(regexp_replace(lower(coalesce({x}, '')), '{BLANKS}+', ' ', 'g')), ';'))"


def uniform(*parts: str) -> str:
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) AS DOUBLE) / {16**13}.0"


def joined(items: str) -> str:
    return f"coalesce(array_to_string({items}, '|'), '')"


def some(items: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN array_to_string({items}, '|') ELSE '-' END"


# ---- inputs

TEMPLATE_ROWS = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(TEMPLATES))
MODEL_ROWS = ", ".join(f"({i}, '{n}', {s})" for n, i, s in MODELS)

PREDICTIONS = f"""
templates AS (SELECT * FROM (VALUES {TEMPLATE_ROWS}) AS t(tid, sql)),
predictions AS (
 SELECT m.model_name, o.o_orderkey AS idx,
  'db_' || CAST(o.o_custkey % 20 AS VARCHAR) AS db_id,
  'Question ' || CAST(o.o_orderkey AS VARCHAR) || '?' AS question,
  g.tid AS gold_tid, p.tid AS pred_tid, g.sql AS gold_sql,
  CASE WHEN (o.o_orderkey + m.mid) % 37 = 0 THEN ''
   WHEN (o.o_orderkey + m.mid) % 41 = 0 THEN 'Sorry, no answer.'
   WHEN o.o_orderkey % 6 = 1 THEN '```sql' || chr(10) || p.sql || chr(10) || '```'
   WHEN o.o_orderkey % 6 = 2 THEN p.sql || ';'
   WHEN o.o_orderkey % 6 = 3 THEN 'Answer: ' || p.sql || chr(10) || 'Note: done'
   WHEN o.o_orderkey % 6 = 4 THEN '  ' || upper(p.sql) || '  '
   ELSE p.sql END AS raw_output,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'easy' WHEN '2-HIGH' THEN 'medium'
   WHEN '3-MEDIUM' THEN 'hard' WHEN '4-NOT SPECIFIED' THEN 'extra' END AS difficulty
 FROM orders o
 CROSS JOIN (VALUES {MODEL_ROWS}) AS m(mid, model_name, skill)
 JOIN templates g ON g.tid = o.o_orderkey % 12
 JOIN templates p ON p.tid = CASE WHEN (o.o_custkey + o.o_orderkey) % 7 < m.skill THEN o.o_orderkey % 12
  ELSE (o.o_orderkey + 1 + o.o_custkey % 11) % 12 END
)"""

TRAIN = f"""
train_templates AS (SELECT * FROM (VALUES {TEMPLATE_ROWS}) AS t(tid, sql)),
train AS (
 SELECT o.o_orderkey AS idx, CASE WHEN o.o_orderkey % 10 = 0 THEN 'validation' ELSE 'train' END AS split,
  'db_' || CAST(o.o_custkey % 25 AS VARCHAR) AS db_id,
  'How is Order ' || CAST(o.o_orderkey AS VARCHAR) || ' placed?' AS question, t.sql AS query
 FROM orders o JOIN train_templates t ON t.tid = (o.o_orderkey + o.o_custkey) % 12
)"""

LONG = f"""
long_questions AS (
 SELECT d.doc_id AS idx, 'db_' || CAST(d.doc_id % 25 AS VARCHAR) AS db_id, d.text AS question, t.sql AS query
 FROM documents d JOIN (VALUES {TEMPLATE_ROWS}) AS t(tid, sql) ON t.tid = d.doc_id % 12
)"""

_COLUMN_ROWS = ", ".join(
    f"({i}, {t}, '{name}', '{kind}', {str(pk).lower()})" for i, (t, name, kind, pk) in enumerate(catalog_columns())
)
_TABLE_ROWS = ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(CATALOG_TABLES))
_KEY_ROWS = ", ".join(f"({i}, {c}, {r})" for i, (c, r) in enumerate(CATALOG_KEYS))
_FULL_TYPES = len(catalog_columns())

CATALOG = f"""
first_seen AS (
 SELECT o_custkey, arg_min(o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END * 1000000000000 + o_orderkey) AS k
 FROM orders GROUP BY o_custkey
),
spots AS (SELECT * FROM (VALUES {_COLUMN_ROWS}) AS c(col_idx, t, col_name, kind, is_pk)),
table_list AS (SELECT * FROM (VALUES {_TABLE_ROWS}) AS t(t, table_name)),
key_list AS (SELECT * FROM (VALUES {_KEY_ROWS}) AS k(fk_pos, col, ref_col)),
placed AS (
 SELECT 'db_' || CAST(o_custkey + 5 AS VARCHAR) AS db_id, col_idx,
  CASE WHEN (o_custkey + t) % 3 = 0 THEN -1 ELSE t END AS table_idx, col_name,
  CASE WHEN k % 2 = 0 OR col_idx < {SHORT_TYPES} THEN kind ELSE '' END AS col_type, is_pk,
  CASE WHEN k % 2 = 0 THEN {_FULL_TYPES} ELSE {SHORT_TYPES} END AS n_types
 FROM first_seen CROSS JOIN spots
),
catalog_rows AS (
 SELECT p.db_id, p.table_idx, t.table_name, p.col_idx, p.col_name, p.col_type, p.is_pk
 FROM placed p JOIN table_list t ON t.t = p.table_idx
),
catalog_fks AS (
 SELECT a.db_id, a.col_idx, a.table_name, a.col_name, k.fk_pos, b.table_name AS ref_table, b.col_name AS ref_column
 FROM catalog_rows a JOIN key_list k ON k.col = a.col_idx
 JOIN catalog_rows b ON b.db_id = a.db_id AND b.col_idx = k.ref_col
)"""


def ddl(types: bool, fks: bool) -> str:
    kind = "CASE WHEN col_type <> '' THEN ' ' || col_type ELSE '' END" if types else "''"
    extra = (
        """UNION ALL SELECT db_id, table_name, 1000 + fk_pos,
  '  FOREIGN KEY (' || col_name || ') REFERENCES ' || ref_table || '(' || ref_column || ')' FROM catalog_fks"""
        if fks
        else ""
    )
    return f"""
ddl_lines AS (
 SELECT db_id, table_name, col_idx AS place,
  '  ' || col_name || {kind} || CASE WHEN is_pk THEN ' PRIMARY KEY' ELSE '' END AS line FROM catalog_rows
 {extra}
),
ddl_tables AS (
 SELECT db_id, table_name, min(place) AS place,
  'CREATE TABLE ' || table_name || ' (' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY place)
   || chr(10) || ');' AS body
 FROM ddl_lines GROUP BY db_id, table_name
),
ddl AS (SELECT db_id, string_agg(body, chr(10) || chr(10) ORDER BY place) AS ddl FROM ddl_tables GROUP BY db_id)"""


DDL = ddl(True, True)


def prompt(ddl_text: str, question: str, query: str | None) -> str:
    nl = "chr(10) || chr(10)"
    head = "'<|start_header_id|>{}<|end_header_id|>' || " + nl
    body = (
        f"'<|begin_of_text|>' || {head.format('system')} || {q(SYSTEM_PROMPT)} || '<|eot_id|>' || "
        f"{head.format('user')} || 'Given the following database schema:' || {nl} || {ddl_text} || {nl} || "
        f"'Question: ' || {question} || '<|eot_id|>' || {head.format('assistant')}"
    )
    return body if query is None else f"{body} || {query} || '<|eot_id|>'"


def with_ddl(table: str) -> str:
    return (
        f"SELECT r.*, coalesce(d.ddl, '-- Unknown database: ' || r.db_id) AS ddl "
        f"FROM {table} r LEFT JOIN ddl d ON d.db_id = r.db_id"
    )


# ---- text

_KEYWORDS = "(?:SELECT|WITH|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)"
_FENCE = r"```(?:sql)?\s*\n?(.*?)\n?```"
_START = _KEYWORDS + r"(?:[^\p{L}\p{N}_].*|$)"
_PROSE = r"\n[ \t]*(?:NOTE:|EXPLANATION:|HERE|(?:THIS|THE|I) [ \t]*[^ \t\n\r]).*"


def extracted(table: str, keys: str) -> str:
    """CTEs that end in (keys, raw_output, pred_sql)."""
    return f"""
stripped AS (SELECT *, {strip("coalesce(raw_output, '')")} AS body FROM {table}),
started AS (SELECT *, regexp_extract(body, '{_START}', 0, 'is') AS stmt FROM stripped),
cleaned AS (
 SELECT {keys},
  CASE WHEN regexp_matches(body, '{_FENCE}', 'is') THEN {strip(f"regexp_extract(body, '{_FENCE}', 1, 'is')")}
   WHEN stmt <> '' THEN {strip(f"rtrim({strip(f'regexp_replace(stmt, {q(_PROSE)}, {q("")}, {q("is")})')}, ';')")}
   ELSE {strip("rtrim(body, ';')")} END AS pred_sql
 FROM started
)"""


CLEANED = PREDICTIONS + "," + extracted(
    "predictions", "model_name, idx, db_id, question, gold_sql, gold_tid, pred_tid, difficulty"
)
SCORED = CLEANED + f""",
scored AS (SELECT *, {normalize('pred_sql')} = {normalize('gold_sql')} AS is_correct FROM cleaned)"""

TEXTS = CLEANED + f""",
varied AS (SELECT replace(replace([{", ".join(q(t) for t in VARIED)}][CAST(o_orderkey % {len(VARIED)} AS INTEGER) + 1],
  '{{k}}', CAST(o_orderkey AS VARCHAR)), '{{c}}', CAST(o_custkey AS VARCHAR)) AS sql FROM orders),
texts AS (SELECT sql, count(*) AS n FROM (SELECT pred_sql AS sql FROM cleaned UNION ALL SELECT sql FROM varied) AS t GROUP BY sql)"""

_JOIN = r"((?:LEFT|RIGHT|INNER|OUTER|CROSS|NATURAL)?\s*JOIN)\s+(\w+)\s+(?:ON|USING)"


def tables_of(x: str) -> str:
    return rf"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '(?:FROM|JOIN)\s+(\w+)', 1, 'i'), lambda t: lower(t))))"


def join_types_of(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{_JOIN}', 1, 'i'), lambda t: trim(t, chr(10) || ' '))"


def join_tables_of(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{_JOIN}', 2, 'i'), lambda t: lower(t))"


def aggregates_of(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '(COUNT|SUM|AVG|MIN|MAX)\s*\(', 1, 'i'), lambda t: upper(t))"


def selects_of(x: str) -> str:
    return f"CAST((length({x}) - length(replace(upper({x}), 'SELECT', ''))) / 6 AS INTEGER)"


def subqueries_of(x: str) -> str:
    return f"greatest({selects_of(x)} - 1, 0)"


def clause_of(x: str, pattern: str, options: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {q(pattern)}, '{options}') THEN {strip(f"regexp_extract({x}, {q(pattern)}, 1, '{options}')")} END"


def where_of(x: str) -> str:
    return clause_of(x, r"WHERE\s+(.+?)(?:GROUP|ORDER|LIMIT|HAVING|$)", "is")


def having_of(x: str) -> str:
    return clause_of(x, r"HAVING\s+(.+?)(?:ORDER|LIMIT|$)", "i")


def group_by_of(x: str) -> str:
    text = clause_of(x, r"GROUP\s+BY\s+(.+?)(?:HAVING|ORDER|LIMIT|$)", "i")
    return f"coalesce(list_transform(string_split({text}, ','), lambda c: lower(trim(c))), [])"


def picked(words: tuple[str, ...], x: str) -> str:
    items = "[" + ", ".join(q(w) for w in words) + "]"
    return f"list_filter({items}, lambda o: contains(upper({x}), o))"


def refs_of(where: str, having: str, groups: str) -> str:
    text = f"coalesce({where}, '') || ' # ' || array_to_string({groups}, ' # ') || ' # ' || coalesce({having}, '')"
    names = rf"regexp_extract_all({text}, '(?:SELECT|ON|WHERE|AND|OR|BY) +(\w+)', 1, 'i')"
    stop = "[" + ", ".join(q(w) for w in NOT_COLUMNS) + "]"
    kept = f"list_filter({names}, lambda c: NOT list_contains({stop}, upper(c)))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda c: lower(c))))"


def simplified(x: str) -> str:
    text = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    for operator, wording in CONDITION_WORDING:
        text = f"replace({text}, '{operator}', '{wording}')"
    return f"lower({text})"


# ---- errors

_PART_COLUMNS = f"""
  {tables_of('sql')} AS tables, {join_types_of('sql')} AS join_types, {join_tables_of('sql')} AS join_tables,
  {aggregates_of('sql')} AS aggs, {subqueries_of('sql')} AS subs, {where_of('sql')} AS where_text,
  {having_of('sql')} AS having_text, {group_by_of('sql')} AS groups, {picked(OPERATORS, 'sql')} AS ops,
  contains(upper(sql), 'LIMIT') AS has_limit"""


def less(a: str, b: str) -> str:
    return f"list_sort(list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x))))"


ERRORS = SCORED + f""",
distinct_texts AS (
 SELECT pred_sql AS sql FROM scored WHERE NOT is_correct UNION SELECT gold_sql FROM scored WHERE NOT is_correct
),
parts AS (SELECT sql, {_PART_COLUMNS} FROM distinct_texts),
faced AS (
 SELECT s.model_name, s.idx, s.db_id, s.question, s.gold_sql, s.pred_sql, coalesce(s.difficulty, 'unknown') AS difficulty,
  CASE WHEN {strip('s.pred_sql')} = '' THEN 'empty_output'
   WHEN NOT regexp_matches({strip('s.pred_sql')}, '^(?:SELECT|WITH|INSERT|UPDATE|DELETE)', 'i') THEN 'invalid_sql' END AS syntax,
  p.tables AS p_tables, g.tables AS g_tables, p.join_types AS p_types, g.join_types AS g_types,
  p.join_tables AS p_jt, g.join_tables AS g_jt, p.aggs AS p_aggs, g.aggs AS g_aggs, p.subs AS p_subs, g.subs AS g_subs,
  p.where_text AS p_where, g.where_text AS g_where, p.having_text AS p_having, g.having_text AS g_having,
  p.groups AS p_groups, g.groups AS g_groups, p.ops AS p_ops, g.ops AS g_ops, p.has_limit AS p_limit, g.has_limit AS g_limit
 FROM scored s JOIN parts p ON p.sql = s.pred_sql JOIN parts g ON g.sql = s.gold_sql WHERE NOT s.is_correct
),
judged AS (
 SELECT *,
  {less('g_tables', 'p_tables')} AS missing_t, {less('p_tables', 'g_tables')} AS extra_t,
  {less('g_jt', 'p_jt')} AS missing_j, {less('p_jt', 'g_jt')} AS extra_j,
  list_sort(list_transform(p_types, lambda x: upper(x))) <> list_sort(list_transform(g_types, lambda x: upper(x))) AS d_types,
  len(p_types) <> len(g_types) AS d_joins,
  list_sort(p_aggs) <> list_sort(g_aggs) AS d_aggs,
  (len(p_groups) > 0) <> (len(g_groups) > 0) AS d_group,
  (len(p_groups) > 0) = (len(g_groups) > 0) AND list_sort(p_groups) <> list_sort(g_groups) AS d_group_cols,
  (p_having IS NULL) <> (g_having IS NULL) AS d_having,
  (p_where IS NULL) <> (g_where IS NULL) AS d_where,
  p_where IS NOT NULL AND g_where IS NOT NULL AND p_ops <> g_ops AS d_ops,
  p_limit <> g_limit AS d_limit, p_subs <> g_subs AS d_subs
 FROM faced
),
flagged AS (
 SELECT *, syntax IS NOT NULL AS e6,
  syntax IS NULL AND (len(missing_t) > 0 OR len(extra_t) > 0) AS e1a,
  syntax IS NULL AND (d_joins OR d_types OR len(missing_j) > 0 OR len(extra_j) > 0) AS e2,
  syntax IS NULL AND (d_aggs OR d_group OR d_group_cols OR d_having) AS e3,
  syntax IS NULL AND (d_where OR d_ops OR d_limit) AS e4,
  syntax IS NULL AND d_subs AS e5
 FROM judged
),
errors AS (
 SELECT *, NOT (e6 OR e1a OR e2 OR e3 OR e4 OR e5) AS fell_back,
  list_filter([CASE WHEN e1a OR NOT (e6 OR e2 OR e3 OR e4 OR e5) THEN 'E1_SCHEMA_LINKING' END, CASE WHEN e2 THEN 'E2_JOIN_ERROR' END,
   CASE WHEN e3 THEN 'E3_AGGREGATION' END, CASE WHEN e4 THEN 'E4_FILTER_CONDITION' END,
   CASE WHEN e5 THEN 'E5_NESTING_SUBQUERY' END, CASE WHEN e6 THEN 'E6_SYNTAX_FORMAT' END], lambda c: c IS NOT NULL) AS categories
 FROM flagged
)"""

_CATEGORY_ROWS = ", ".join(f"({i}, '{c}', '{label}')" for i, (c, label) in enumerate(CATEGORIES.items(), 1))

DISTRIBUTION = ERRORS + f""",
cats AS (SELECT * FROM (VALUES {_CATEGORY_ROWS}) AS c(cat_order, category, label)),
model_totals AS (
 SELECT model_name, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct,
  count(*) FILTER (WHERE NOT is_correct) AS incorrect FROM scored GROUP BY model_name
),
shown AS (SELECT model_name, idx, difficulty, unnest(categories) AS category, categories[1] AS first FROM errors),
any_counts AS (SELECT model_name, category, count(*) AS n FROM shown GROUP BY ALL),
first_counts AS (SELECT model_name, categories[1] AS category, count(*) AS n FROM errors GROUP BY ALL),
distribution AS (
 SELECT m.model_name, c.category, c.cat_order, c.label, coalesce(a.n, 0) AS n, m.total, m.correct, m.incorrect,
  CASE WHEN m.incorrect > 0 THEN coalesce(a.n, 0) / m.incorrect * 100 ELSE 0 END AS pct_of_errors,
  CASE WHEN m.total > 0 THEN coalesce(a.n, 0) / m.total * 100 ELSE 0 END AS pct_of_total
 FROM model_totals m CROSS JOIN cats c LEFT JOIN any_counts a ON a.model_name = m.model_name AND a.category = c.category
),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY n DESC, cat_order) AS rank FROM distribution
)"""

WEAK = DISTRIBUTION + """,
passing AS (
 SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY rank) AS place FROM ranked WHERE pct_of_errors >= 15
),
weak AS (
 SELECT model_name, category, pct_of_errors AS error_rate, rank FROM passing WHERE place <= 3
 UNION ALL
 SELECT model_name, category, pct_of_errors, rank FROM ranked
 WHERE rank <= 3 AND model_name NOT IN (SELECT model_name FROM passing)
)"""

RELATED = WEAK + "," + TRAIN + """,
error_dbs AS (
 SELECT DISTINCT s.model_name, s.category, e.db_id FROM shown s
 JOIN errors e ON e.model_name = s.model_name AND e.idx = s.idx
 JOIN weak w ON w.model_name = s.model_name AND w.category = s.category
),
related AS (
 SELECT d.model_name, d.category, t.idx, t.db_id, t.question, t.query FROM train t JOIN error_dbs d ON d.db_id = t.db_id
)"""


# ---- rewrites

_DRAW = uniform("42", "idx", "copy")


def _aggregate_phrase() -> str:
    first = r"upper(regexp_extract(query, '(COUNT|SUM|AVG|MAX|MIN)\s*\(', 1, 'i'))"
    cases = " ".join(
        f"WHEN '{name}' THEN [{', '.join(q(w) for w in words)}][CAST(floor({_DRAW} * {len(words)}) AS INTEGER) + 1]"
        for name, words in AGGREGATE_WORDING.items()
    )
    return f"'Find the ' || CASE {first} {cases} END || ' — ' || question"


_ALL_TABLES = r"regexp_extract_all(query, '(?:FROM|JOIN)\s+(\w+)', 1, 'i')"
_KEY_COLUMNS = r"regexp_extract_all(query, '(?:SELECT|WHERE|ON|BY)\s+(?:\w+\.)?(\w+)', 1, 'i')"
_PATH = r"regexp_extract_all(query, 'JOIN\s+(\w+)\s+.*?ON\s+(.*?)(?:JOIN|WHERE|GROUP|ORDER|LIMIT|$)', 1, 'is')"
_FILTER = clause_of("query", r"WHERE\s+(.+?)(?:GROUP|ORDER|LIMIT|$)", "is")
# the distinct names in the order they first occur
_FIRST_NAMES = (
    f"list_transform(list_slice(list_sort(list_transform(list_distinct({_KEY_COLUMNS}), "
    f"lambda c: [lpad(CAST(list_position({_KEY_COLUMNS}, c) AS VARCHAR), 6, '0'), c])), 1, 3), lambda p: p[2])"
)

REWRITES = {
    "E1_column_hint": f"""CASE WHEN len({_ALL_TABLES}) > 0 THEN rtrim(rtrim(question, '?'), '.') || ' (using table'
  || CASE WHEN len({_ALL_TABLES}) > 1 THEN 's' ELSE '' END || ': ' || array_to_string({_ALL_TABLES}, ', ') || ')?' END""",
    "E1_table_context": f"""CASE WHEN len({_KEY_COLUMNS}) > 0 THEN 'Considering columns like '
  || array_to_string({_FIRST_NAMES}, ', ') || ', ' || lower(question) END""",
    "E2_join_path": f"""CASE WHEN len({_PATH}) > 0 THEN question || ' (connecting '
  || array_to_string(list_transform({_PATH}, lambda t: 'through ' || t), ' ') || ')' END""",
    "E2_join_emphasis": "CASE WHEN contains(upper(query), 'JOIN') THEN 'By joining the relevant tables, ' || lower(question) END",
    "E3_agg_rephrase": _aggregate_phrase(),
    "E3_group_by_emphasis": "CASE WHEN contains(upper(query), 'GROUP BY') THEN 'Group the results and ' || lower(question) END",
    "E4_condition_explicit": f"question || ' (with the condition that ' || {simplified(_FILTER)} || ')'",
    "E4_comparison_emphasis": """CASE WHEN contains(query, '>') OR contains(query, '<') OR contains(query, '!=')
  THEN 'With appropriate comparisons, ' || lower(question) END""",
    "E5_subquery_hint": f"CASE WHEN {selects_of('query')} > 1 THEN 'Using a subquery approach, ' || lower(question) END",
    "E5_decomposition": f"""CASE WHEN {selects_of('query')} > 1 AND (contains(upper(query), 'IN') OR contains(upper(query), 'EXISTS'))
  THEN 'First identify the relevant subset, then ' || lower(question) END""",
}

_CATEGORY_OF = {name: next(c for c in CATEGORIES if c[:2] == name[:2]) for name in REWRITES}


def rewritten(table: str, keys: str) -> str:
    """A CTE with one row per example, copy and rewrite that applies."""
    branches = " UNION ALL ".join(
        f"SELECT {keys}, copy, '{name}' AS augmentation_type, {text} AS question "
        f"FROM copies WHERE category = '{_CATEGORY_OF[name]}'"
        for name, text in REWRITES.items()
    )
    return f"""
copies AS (SELECT * FROM {table} CROSS JOIN (VALUES (1), (2), (3)) AS c(copy)),
augmented AS (SELECT * FROM ({branches}) AS a WHERE question IS NOT NULL)"""


AUGMENTED = RELATED + "," + rewritten("related", "model_name, category, idx, db_id, query")

# ---- significance

_REPS = 10_000
_PLACES = [((1 - 0.95) / 2) * (_REPS - 1), (1 - (1 - 0.95) / 2) * (_REPS - 1)]


def intervals(scored: str) -> str:
    """CTEs that end in intervals(model_name, n, k, ci_lower, ci_upper)."""
    ranks = [r for p in _PLACES for r in (math.floor(p), math.ceil(p))]
    us = ", ".join(f"max(u) FILTER (WHERE r = {rank}) AS u{i}" for i, rank in enumerate(ranks))
    draws = ", ".join(f"coalesce(min(j) FILTER (WHERE cdf >= u{i}), max(j)) / n AS d{i}" for i in range(4))
    low, high = (p - math.floor(p) for p in _PLACES)
    return f"""
uniforms AS (
 SELECT u, row_number() OVER (ORDER BY u) - 1 AS r FROM (SELECT {uniform('42', 'i')} AS u FROM range({_REPS}) AS t(i)) AS d
),
quantiles AS (SELECT {us} FROM uniforms),
hit_counts AS (
 SELECT model_name, count(*) AS n, count(*) FILTER (WHERE is_correct) AS k FROM {scored} GROUP BY model_name
),
points AS (SELECT model_name, n, k, unnest(range(0, n + 1)) AS j FROM hit_counts),
weights AS (
 SELECT *, CASE WHEN k = 0 OR k = n THEN CASE WHEN j = k THEN 1.0 ELSE 0.0 END
  ELSE exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / n) + (n - j) * ln(1 - k / n)) END AS w
 FROM points
),
cdfs AS (
 SELECT model_name, n, k, j, sum(w) OVER (PARTITION BY model_name ORDER BY j ROWS UNBOUNDED PRECEDING)
  / sum(w) OVER (PARTITION BY model_name) AS cdf FROM weights
),
drawn AS (SELECT model_name, n, k, {draws} FROM cdfs CROSS JOIN quantiles GROUP BY model_name, n, k),
intervals AS (
 SELECT model_name, n, k, d0 + (d1 - d0) * {low!r} AS ci_lower, d2 + (d3 - d2) * {high!r} AS ci_upper FROM drawn
)"""


def paired(scored: str) -> str:
    return f"""
paired AS (
 SELECT a.model_name AS model_a, b.model_name AS model_b,
  count(*) FILTER (WHERE a.is_correct AND NOT b.is_correct) AS b10,
  count(*) FILTER (WHERE NOT a.is_correct AND b.is_correct) AS b01,
  count(*) FILTER (WHERE a.is_correct AND b.is_correct) AS both_right,
  count(*) FILTER (WHERE NOT a.is_correct AND NOT b.is_correct) AS neither
 FROM {scored} a JOIN {scored} b ON a.idx = b.idx AND a.model_name < b.model_name GROUP BY ALL
),
accuracies AS (
 SELECT model_name, count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM {scored} GROUP BY model_name
),
tested AS (
 SELECT *, CASE WHEN b01 + b10 = 0 THEN 0 ELSE power(abs(b01 - b10) - 1, 2) / (b01 + b10) END AS chi2 FROM paired
),
tails AS (
 SELECT *, list_reduce(list_prepend(struct_pack(term := 2.0::DOUBLE, total := 2.0::DOUBLE),
   list_transform(range(1, 201), lambda i: struct_pack(term := chi2 / 2 / (i + 0.5), total := 0.0::DOUBLE))),
   lambda a, f: struct_pack(term := a.term * f.term, total := a.total + a.term * f.term)).total AS series FROM tested
),
p_values AS (
 SELECT *, CASE WHEN b01 + b10 = 0 THEN 1.0 WHEN chi2 > 70 THEN 0.0
  ELSE greatest(0.0, 1 - sqrt(chi2 / 2) * exp(-chi2 / 2) / sqrt(pi()) * series) END AS p FROM tails
)"""


TEST_ROWS = """SELECT t.model_a, t.model_b, round(a.accuracy, 9) AS accuracy_a, round(b.accuracy, 9) AS accuracy_b,
 round(chi2, 9) AS mcnemar_chi2, round(p, 9) AS p_value, p < 0.05 AS significant_at_05, p < 0.01 AS significant_at_01
FROM p_values t JOIN accuracies a ON a.model_name = t.model_a JOIN accuracies b ON b.model_name = t.model_b"""

LABEL_SCORES = """
label_scores AS (
 SELECT doc_id AS idx, 'quality' AS model_name, quality = 1 AS is_correct FROM labels
 UNION ALL SELECT doc_id, 'toxic', toxic = 0 FROM labels
)"""

_LEVELS = ("easy", "medium", "hard", "extra")


def level(name: str) -> str:
    return (
        f"coalesce(count(*) FILTER (WHERE is_correct AND coalesce(difficulty, 'unknown') = '{name}') "
        f"/ nullif(count(*) FILTER (WHERE coalesce(difficulty, 'unknown') = '{name}'), 0), 0.0)"
    )


def accuracy(keys: str, groups: str) -> str:
    return f"""WITH {SCORED} SELECT {keys}, count(*) FILTER (WHERE is_correct) AS correct, count(*) AS total,
 count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM scored GROUP BY {groups}"""


def running(source: str, every: int = 50) -> str:
    return f"""numbered AS (
 SELECT model_name, row_number() OVER w AS examples, sum(CASE WHEN is_correct THEN 1 ELSE 0 END) OVER w AS correct
 FROM {source} WINDOW w AS (PARTITION BY model_name ORDER BY idx ROWS UNBOUNDED PRECEDING)
) SELECT model_name, examples, CAST(correct AS BIGINT) AS correct, correct / examples AS accuracy
FROM numbered WHERE examples % {every} = 0"""


def histogram(ctes: str, source: str, value: str, bins: int) -> str:
    edge = "lo + {} * ((hi - lo) / %d)" % bins
    return f"""WITH {ctes},
xs AS (SELECT CAST({value} AS DOUBLE) AS x FROM {source} WHERE {value} IS NOT NULL),
ends AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
 CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM xs),
edges AS (SELECT CAST(b AS INTEGER) AS bin, {edge.format('b')} AS bin_start,
 CASE WHEN b = {bins - 1} THEN hi ELSE {edge.format('(b + 1)')} END AS bin_end FROM ends, range({bins}) AS r(b))
SELECT bin, round(bin_start, 9) AS bin_start, round(bin_end, 9) AS bin_end, count(x) AS count
FROM edges LEFT JOIN xs ON x >= bin_start AND (x < bin_end OR (bin = {bins - 1} AND x = bin_end))
GROUP BY bin, bin_start, bin_end"""


def check(where: str, columns: str) -> str:
    return f"WITH {ERRORS} SELECT model_name, idx, {columns} FROM errors WHERE {where}"


def yes(flag: str, value: str) -> str:
    return f"CASE WHEN {flag} THEN CAST({value} AS VARCHAR) ELSE '-' END"


def texts(column: str, expression: str) -> str:
    return f"WITH {TEXTS} SELECT sql, n, {expression} AS {column} FROM texts"


def _execution() -> str:
    """Result sets of the templates as sorted lists of distinct rows, compared for every prediction."""
    results = " UNION ALL ".join(
        f"SELECT {i} AS tid, (SELECT list_sort(list(DISTINCT CAST(r AS VARCHAR))) FROM ({t}) AS r) AS found"
        for i, t in enumerate(TEMPLATES)
    )
    return f"""WITH {CLEANED}, results AS ({results}),
ran AS (
 SELECT c.model_name, c.idx, starts_with(upper(c.pred_sql), 'SELECT') AS pred_success, p.found = g.found AS same
 FROM cleaned c JOIN results p ON p.tid = c.pred_tid JOIN results g ON g.tid = c.gold_tid
) SELECT model_name, idx, pred_success AND same AS is_correct, true AS gold_success, pred_success, 'execution' AS method FROM ran"""


ORACLES: dict[str, str] = {
    "load_examples": f"""WITH {TRAIN} SELECT split, db_id, question, query,
 CAST(len(string_split(query, ' ')) AS INTEGER) AS n_query_toks,
 CAST(len(string_split(question, ' ')) AS INTEGER) AS n_question_toks FROM train""",
    "split_examples": f"""WITH {TRAIN}, placed AS (
 SELECT idx, row_number() OVER (ORDER BY md5('42|' || CAST(idx AS VARCHAR))) AS place, count(*) OVER () AS n FROM train
) SELECT idx, CASE WHEN place <= ceil(0.1 * n) THEN 'validation' ELSE 'train' END AS split FROM placed""",
    "load_examples_positions": f"""WITH {TRAIN},
third AS (SELECT CASE WHEN idx % 7 = 0 THEN 'test' ELSE split END AS split FROM train)
SELECT split, count(*) AS n_rows, count(*) AS n_positions, CAST(0 AS BIGINT) AS first_idx FROM third GROUP BY split""",
    "split_examples_kept": f"WITH {TRAIN} SELECT idx, split FROM train",
    "subset_of_splits": f"""WITH {TRAIN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY idx) AS place FROM train)
SELECT split, idx, db_id FROM ranked WHERE place <= CASE WHEN split = 'train' THEN 700 ELSE 90 END""",
    "result_sets_last_cent": """SELECT count(*) FILTER (WHERE l_orderkey % 7 = 0) AS only_a, count(*) FILTER (WHERE l_orderkey % 7 = 0) AS only_b,
 count(*) FILTER (WHERE l_orderkey % 7 <> 0) AS in_both, false AS equal FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) AS d""",
    "result_sets_twelfth_digit": """SELECT count(*) FILTER (WHERE l_orderkey % 7 = 0) AS only_a, count(*) FILTER (WHERE l_orderkey % 7 = 0) AS only_b,
 count(*) FILTER (WHERE l_orderkey % 7 <> 0) AS in_both, false AS equal
FROM (SELECT DISTINCT l_orderkey, l_orderkey * 10 + l_linenumber AS place FROM lineitem) AS d""",
    "result_digests_differ": """SELECT count(*) AS n_rows, false AS same, true AS repeated
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) AS d""",
    "score_execution_errors": """WITH p AS (SELECT p_partkey AS idx FROM part)
SELECT idx, idx % 5 = 2 AS match, true AS gold_success,
 idx % 5 = 2 OR idx % 5 = 3 AND idx % 2 = 0 AS pred_success, '-' AS gold_error,
 CASE WHEN idx % 5 = 0 THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' WHEN idx % 5 = 1 THEN 'DIVIDE_BY_ZERO' WHEN idx % 5 = 2 THEN '-'
  WHEN idx % 5 = 3 THEN CASE WHEN idx % 2 = 0 THEN '-' ELSE 'UNRESOLVED_COLUMN.WITH_SUGGESTION' END ELSE 'Empty SQL query' END AS pred_error
FROM p""",
    "difficulty_summary": f"""WITH {SCORED}, {intervals('scored')}, levels AS (
 SELECT model_name, coalesce(difficulty, 'unknown') AS difficulty, count(*) AS level_total, avg(CAST(is_correct AS INTEGER)) AS level_accuracy
 FROM scored GROUP BY ALL)
SELECT i.model_name, round(k / n, 9) AS accuracy, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper, n AS num_examples,
 difficulty, round(level_accuracy, 9) AS level_accuracy, level_total FROM intervals i JOIN levels l ON l.model_name = i.model_name""",
    "take_first": f"WITH {TRAIN} SELECT idx, db_id, query FROM train ORDER BY idx LIMIT 500",
    "take_first_long": f"WITH {TRAIN} SELECT idx, db_id, query FROM train ORDER BY idx LIMIT 12000",
    "schema_catalog": f"""WITH {CATALOG} SELECT db_id, '{'|'.join(n for n, _ in CATALOG_TABLES)}' AS table_names,
 string_agg(CAST(table_idx AS VARCHAR) || ':' || col_name, '|' ORDER BY col_idx) AS columns,
 string_agg(kind, '|' ORDER BY col_idx) FILTER (WHERE col_idx < n_types) AS column_types
FROM placed JOIN spots USING (col_idx, col_name) GROUP BY db_id""",
    "catalog_long": f"""WITH {CATALOG} SELECT r.db_id, r.table_idx, r.table_name, r.col_idx, r.col_name, r.col_type, r.is_pk,
 coalesce(string_agg(CAST(fk_pos AS VARCHAR) || ':' || ref_table || ':' || ref_column, '|' ORDER BY fk_pos), '') AS fks
FROM catalog_rows r LEFT JOIN catalog_fks f ON f.db_id = r.db_id AND f.col_idx = r.col_idx GROUP BY ALL""",
    "register_databases": " UNION ALL ".join(
        f"SELECT '{db}' AS db_id, '{name}' AS table_name, count(*) AS n_rows FROM {source}"
        for db, name, source in [("given", t, t) for t in GIVEN_TABLES] + [("other", "orders", "nation")]
    ),
    "extract_sql": f"WITH {CLEANED} SELECT model_name, idx, pred_sql FROM cleaned",
    "extract_sql_chat": f"""WITH chat AS (SELECT conv_id, turn, text AS raw_output FROM conversations WHERE role = 'assistant'),
{extracted('chat', 'conv_id, turn')} SELECT conv_id, turn, pred_sql FROM cleaned""",
    "normalize_sql": f"WITH {CLEANED} SELECT model_name, idx, {normalize('pred_sql')} AS norm_sql FROM cleaned",
    "normalize_documents": f"""WITH {LONG}, normed AS (SELECT idx, {normalize('question')} AS t FROM long_questions)
SELECT idx, md5(t) AS norm_md5, CAST(length(t) AS INTEGER) AS norm_length FROM normed""",
    "example_hash": f"WITH {TRAIN} SELECT idx, substr(md5(db_id || '||' || question), 1, 12) AS example_hash FROM train",
    "sql_tables": texts("tables", joined(tables_of("sql"))),
    "sql_joins": texts(
        "joins", joined(f"list_transform(list_zip({join_types_of('sql')}, {join_tables_of('sql')}), lambda z: z[1] || ':' || z[2])")
    ),
    "sql_aggregates": texts("aggregates", joined(aggregates_of("sql"))),
    "subquery_count": texts("subqueries", subqueries_of("sql")),
    "sql_group_by": texts("group_by", joined(group_by_of("sql"))),
    "sql_having": texts("having_text", f"coalesce({having_of('sql')}, '-')"),
    "sql_where": texts("where_text", f"coalesce({where_of('sql')}, '-')"),
    "sql_features": f"""WITH {CLEANED}, distinct_texts AS (SELECT DISTINCT pred_sql AS sql FROM cleaned),
parts AS (SELECT sql, {_PART_COLUMNS} FROM distinct_texts)
SELECT c.model_name, c.idx, {joined('p.tables')} AS tables, CAST(len(p.join_types) AS INTEGER) AS n_joins,
 {joined('p.aggs')} AS aggregates, coalesce(p.where_text, '-') AS where_text, p.subs AS subqueries,
 {joined('p.groups')} AS group_by, coalesce(p.having_text, '-') AS having_text, c.pred_sql <> '' AS is_valid
FROM cleaned c JOIN parts p ON p.sql = c.pred_sql""",
    "sql_operators": texts("operators", joined(picked(OPERATORS, "sql"))),
    "condition_column_refs": texts("refs", joined(refs_of(where_of("sql"), having_of("sql"), group_by_of("sql")))),
    "keyword_flags": texts("keywords", joined(picked(CORPUS_KEYWORDS, "sql"))),
    "simplify_condition": texts("words", f"coalesce({simplified(where_of('sql'))}, '-')"),
    "schema_ddl": f"WITH {CATALOG}, {DDL} SELECT db_id, ddl FROM ddl",
    "schema_ddl_plain": f"WITH {CATALOG}, {ddl(False, False)} SELECT db_id, ddl FROM ddl",
    "attach_ddl": f"WITH {CATALOG}, {DDL}, {TRAIN}, placed_rows AS ({with_ddl('train')}) SELECT idx, db_id, ddl FROM placed_rows",
    "catalog_sizes": f"""WITH {CATALOG} SELECT db_id, CAST({len(CATALOG_TABLES)} AS BIGINT) AS n_tables,
 count(*) FILTER (WHERE table_idx >= 0) AS n_columns FROM placed GROUP BY db_id""",
    "format_prompt": f"""WITH {CATALOG}, {DDL}, {TRAIN}, placed_rows AS ({with_ddl('train')})
SELECT idx, {prompt('ddl', 'question', 'query')} AS text FROM placed_rows""",
    "inference_prompt": f"""WITH {CATALOG}, {DDL}, {TRAIN}, placed_rows AS ({with_ddl('train')})
SELECT idx, {prompt('ddl', 'question', None)} AS text FROM placed_rows""",
    "prepare_training_data": f"""WITH {CATALOG}, {DDL}, {LONG}, placed_rows AS ({with_ddl('long_questions')}),
prompts AS (SELECT idx, db_id, {prompt('ddl', 'question', 'query')} AS text FROM placed_rows)
SELECT idx, db_id, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS text_length FROM prompts WHERE length(text) <= 4096""",
    "training_drops": f"""WITH {CATALOG}, {DDL}, {LONG}, placed_rows AS ({with_ddl('long_questions')}),
prompts AS (SELECT length({prompt('ddl', 'question', 'query')}) AS n FROM placed_rows)
SELECT count(*) AS examples, count(*) FILTER (WHERE n <= 4096) AS kept, count(*) FILTER (WHERE n > 4096) AS dropped FROM prompts""",
    "prepare_training_counts": f"""WITH {CATALOG}, {DDL}, {LONG}, placed_rows AS ({with_ddl('long_questions')}),
prompts AS (SELECT length({prompt('ddl', 'question', 'query')}) AS n FROM placed_rows)
SELECT count(*) AS examples, count(*) FILTER (WHERE n <= 4096) AS kept, count(*) FILTER (WHERE n > 4096) AS dropped,
 count(*) FILTER (WHERE n <= 4096) AS read, CAST(sum(n) FILTER (WHERE n <= 4096) AS BIGINT) AS characters FROM prompts""",
    "score_exact": f"WITH {SCORED} SELECT model_name, idx, is_correct FROM scored",
    "exact_details": f"""WITH {CLEANED} SELECT model_name, idx, 'string_match' AS method,
 {normalize('pred_sql')} AS norm_pred, {normalize('gold_sql')} AS norm_gold FROM cleaned""",
    "result_sets_equal_repeats": """SELECT CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, count(*) AS in_both,
 true AS equal FROM (SELECT DISTINCT l_partkey, l_quantity, l_returnflag FROM lineitem) AS d""",
    "result_sets_equal": """WITH a AS (SELECT DISTINCT l_orderkey, l_returnflag, l_discount FROM lineitem),
b AS (SELECT DISTINCT l_orderkey, l_returnflag, CASE WHEN l_quantity = 11 THEN l_discount + 1 ELSE l_discount END AS l_discount FROM lineitem),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) AS x) AS only_a,
 (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) AS x) AS only_b,
 (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) AS x) AS in_both)
SELECT *, only_a = 0 AND only_b = 0 AS equal FROM c""",
    "result_digest": """SELECT CAST(3 AS INTEGER) AS width, count(*) AS n_rows, true AS same
FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linestatus FROM lineitem) AS d""",
    "score_execution": _execution(),
    "accuracy_overall": accuracy("model_name", "model_name"),
    "accuracy_by_difficulty": accuracy("model_name, coalesce(difficulty, 'unknown') AS difficulty", "model_name, coalesce(difficulty, 'unknown')"),
    "accuracy_by_database": accuracy("model_name, db_id", "model_name, db_id"),
    "running_accuracy": f"WITH {SCORED}, {running('scored')}",
    "running_accuracy_sparse": f"""WITH event_scores AS (SELECT event_type AS model_name, event_id AS idx, value > 10 AS is_correct FROM events),
{running('event_scores')}""",
    "bootstrap_ci": f"""WITH {SCORED}, {intervals('scored')}
SELECT model_name, round(k / n, 9) AS mean, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper FROM intervals""",
    "bootstrap_ci_labels": f"""WITH {LABEL_SCORES}, {intervals('label_scores')}
SELECT model_name, round(k / n, 9) AS mean, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper FROM intervals""",
    "model_summary": f"""WITH {SCORED}, {intervals('scored')} SELECT model_name, round(k / n, 9) AS accuracy,
 round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper, n AS num_examples FROM intervals""",
    "mcnemar_table": f"""WITH {SCORED}, {paired('scored')}
SELECT model_a, model_b, b10, b01, both_right AS both, neither FROM paired""",
    "mcnemar_test": f"WITH {SCORED}, {paired('scored')} {TEST_ROWS}",
    "mcnemar_test_labels": f"WITH {LABEL_SCORES}, {paired('label_scores')} {TEST_ROWS}",
    "accuracy_pivot": f"""WITH {SCORED}, {intervals('scored')},
wide AS (SELECT model_name, {', '.join(f'{level(d)} AS {d}' for d in _LEVELS)} FROM scored GROUP BY model_name)
SELECT w.model_name, round(k / n, 9) AS overall, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper,
 {', '.join(f'round({d}, 9) AS {d}' for d in _LEVELS)} FROM wide w JOIN intervals i ON i.model_name = w.model_name""",
    "accuracy_grid": f"""WITH {SCORED} """ + " UNION ALL ".join(
        f"SELECT model_name, '{d}' AS difficulty, round({level(d)}, 9) AS accuracy FROM scored GROUP BY model_name"
        for d in (*_LEVELS, "unknown")
    ),
    "check_syntax": check(
        "e6",
        """syntax AS error_type, CASE WHEN syntax = 'empty_output' THEN 'Model produced empty or no SQL'
 ELSE 'SQL failed to parse: ' || substr(pred_sql, 1, 100) || '...' END AS description""",
    ),
    "check_schema_linking": f"""WITH {ERRORS}, {CATALOG},
db_columns AS (SELECT db_id, list(lower(col_name)) AS cols FROM catalog_rows GROUP BY db_id),
with_refs AS (
 SELECT e.*, CASE WHEN c.cols IS NULL THEN [] ELSE {less(refs_of('p_where', 'p_having', 'p_groups'), 'c.cols')} END AS unknown
 FROM errors e LEFT JOIN db_columns c ON c.db_id = e.db_id WHERE NOT e6
) SELECT model_name, idx, {some('missing_t')} AS missing_tables, {some('extra_t')} AS extra_tables,
 {some('unknown')} AS hallucinated_columns FROM with_refs WHERE len(missing_t) + len(extra_t) + len(unknown) > 0""",
    "check_joins": check(
        "e2",
        f"""{yes('d_joins', 'len(p_types)')} AS pred_joins, {yes('d_joins', 'len(g_types)')} AS gold_joins,
 CASE WHEN d_types THEN {joined('list_transform(p_types, lambda x: upper(x))')} ELSE '-' END AS pred_types,
 CASE WHEN d_types THEN {joined('list_transform(g_types, lambda x: upper(x))')} ELSE '-' END AS gold_types,
 {some('missing_j')} AS missing_join_tables, {some('extra_j')} AS extra_join_tables""",
    ),
    "check_aggregation": check(
        "e3",
        f"""CASE WHEN d_aggs THEN {joined('list_sort(p_aggs)')} ELSE '-' END AS pred_aggs,
 CASE WHEN d_aggs THEN {joined('list_sort(g_aggs)')} ELSE '-' END AS gold_aggs,
 {yes('d_group', '(len(p_groups) > 0)')} AS pred_has_group_by,
 CASE WHEN d_group_cols THEN {joined('p_groups')} ELSE '-' END AS pred_group_by,
 CASE WHEN d_group_cols THEN {joined('g_groups')} ELSE '-' END AS gold_group_by,
 {yes('d_having', '(p_having IS NOT NULL)')} AS pred_has_having""",
    ),
    "check_filter": check(
        "e4",
        f"""{yes('d_where', '(p_where IS NOT NULL)')} AS pred_has_where,
 CASE WHEN d_ops THEN {joined('p_ops')} ELSE '-' END AS pred_operators,
 CASE WHEN d_ops THEN {joined('g_ops')} ELSE '-' END AS gold_operators, {yes('d_limit', 'p_limit')} AS pred_has_limit""",
    ),
    "check_nesting": check("e5", "p_subs AS pred_subqueries, g_subs AS gold_subqueries"),
    "classify_errors": f"""WITH {ERRORS} SELECT model_name, idx, {joined('categories')} AS categories, categories[1] AS primary_category,
 CAST(CASE WHEN e6 THEN 3 ELSE least(len(categories), 3) END AS INTEGER) AS severity,
 CASE WHEN fell_back THEN {q(FALLBACK)} ELSE '-' END AS fallback FROM errors""",
    "error_summary": f"""WITH {DISTRIBUTION} SELECT model_name, total, correct, incorrect, correct / total AS accuracy,
 incorrect / total AS error_rate FROM model_totals""",
    "category_distribution": f"""WITH {DISTRIBUTION} SELECT model_name, category, cat_order, n AS count,
 round(pct_of_errors, 9) AS pct_of_errors, round(pct_of_total, 9) AS pct_of_total FROM distribution""",
    "primary_distribution": f"""WITH {DISTRIBUTION} SELECT d.model_name, d.category, d.cat_order, coalesce(f.n, 0) AS count,
 round(CASE WHEN d.incorrect > 0 THEN coalesce(f.n, 0) / d.incorrect * 100 ELSE 0 END, 9) AS pct_of_errors
FROM distribution d LEFT JOIN first_counts f ON f.model_name = d.model_name AND f.category = d.category""",
    "difficulty_error_matrix": f"""WITH {ERRORS} SELECT model_name, difficulty,
 {', '.join(f"count(*) FILTER (WHERE list_contains(categories, '{c}')) AS {c}" for c in CATEGORIES)}
FROM errors GROUP BY model_name, difficulty""",
    "matrix_row_percent": f"""WITH {DISTRIBUTION},
cells AS (SELECT model_name, difficulty, category, count(*) AS n FROM shown GROUP BY ALL),
levels AS (SELECT DISTINCT model_name, difficulty FROM errors),
grid AS (
 SELECT l.model_name, l.difficulty, c.cat_order, c.category, coalesce(x.n, 0) AS count FROM levels l CROSS JOIN cats c
 LEFT JOIN cells x ON x.model_name = l.model_name AND x.difficulty = l.difficulty AND x.category = c.category
) SELECT *, round(count / sum(count) OVER (PARTITION BY model_name, difficulty) * 100, 9) AS pct_of_row FROM grid""",
    "ranked_weaknesses": f"""WITH {DISTRIBUTION} SELECT model_name, category, label, n AS count,
 round(pct_of_errors, 9) AS error_rate, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3""",
    "distribution_shift": f"""WITH {DISTRIBUTION}, pairs AS (SELECT * FROM (VALUES ('base', 'round1'), ('round1', 'round2')) AS p(b, a))
SELECT p.b AS model_before, p.a AS model_after, x.category, x.label, round(x.pct_of_total, 9) AS before_pct,
 round(y.pct_of_total, 9) AS after_pct, round(y.pct_of_total - x.pct_of_total, 9) AS change_pct,
 CASE WHEN y.pct_of_total < x.pct_of_total THEN 'improved' WHEN y.pct_of_total > x.pct_of_total THEN 'worsened'
  ELSE 'unchanged' END AS direction, round(y.correct / y.total - x.correct / x.total, 9) AS accuracy_change
FROM pairs p JOIN distribution x ON x.model_name = p.b JOIN distribution y ON y.model_name = p.a AND y.category = x.category""",
    "weak_categories": f"""WITH {WEAK} SELECT model_name, category, round(error_rate, 9) AS error_rate,
 CAST(rank AS INTEGER) AS rank FROM weak""",
    "error_examples": f"""WITH {WEAK} SELECT s.model_name, s.category, s.idx, e.db_id FROM shown s
JOIN weak w ON w.model_name = s.model_name AND w.category = s.category
JOIN errors e ON e.model_name = s.model_name AND e.idx = s.idx""",
    "related_examples": f"WITH {RELATED} SELECT model_name, category, idx, db_id FROM related",
    "augment": f"WITH {AUGMENTED} SELECT model_name, category, idx, copy, db_id, augmentation_type, question FROM augmented",
    "augmentation_stats": f"""WITH {AUGMENTED},
sources AS (
 SELECT model_name, category FROM related UNION ALL
 SELECT s.model_name, s.category FROM shown s JOIN weak w ON w.model_name = s.model_name AND w.category = s.category
),
counted AS (SELECT model_name, category, count(*) AS n FROM sources WHERE category <> 'E6_SYNTAX_FORMAT' GROUP BY ALL),
made AS (SELECT model_name, category, count(*) AS n FROM augmented GROUP BY ALL)
SELECT c.model_name, c.category, c.n AS source_examples, coalesce(m.n, 0) AS augmented_examples
FROM counted c LEFT JOIN made m ON m.model_name = c.model_name AND m.category = c.category""",
    "augmentation_totals": f"""WITH {AUGMENTED}, t AS (SELECT count(*) AS n FROM train)
SELECT model_name, max(t.n) AS total_original, count(*) AS total_augmented, max(t.n) + count(*) AS total_combined
FROM augmented CROSS JOIN t GROUP BY model_name""",
    "training_mix": f"""WITH {AUGMENTED}, {CATALOG}, {DDL},
rows_made AS (
 SELECT idx, db_id, question, query, copy, augmentation_type, model_name, category, true AS kept FROM augmented
 WHERE model_name = 'round1'
 UNION ALL SELECT idx, db_id, question, query, 0, '', '', '', false FROM train
),
placed_rows AS ({with_ddl('rows_made')}),
prompts AS (SELECT *, {prompt('ddl', 'question', 'query')} AS text FROM placed_rows)
SELECT md5('42|' || CAST(idx AS VARCHAR) || '|' || CAST(copy AS VARCHAR) || '|' || augmentation_type || '|' || model_name || '|' || category) AS place, idx, db_id,
 CASE WHEN augmentation_type = '' THEN '-' ELSE augmentation_type END AS augmentation_type, md5(text) AS text_md5
FROM prompts WHERE kept OR length(text) <= 4096""",
    "training_mix_shuffled": f"""WITH {TRAIN},
mix AS (SELECT db_id, md5('42|' || CAST(idx AS VARCHAR) || '|' || CAST(copy AS VARCHAR) || '|||') AS place
 FROM train CROSS JOIN (VALUES (0), (1)) AS c(copy))
SELECT CAST(floor(CAST('0x' || substr(place, 1, 1) AS INTEGER) / 2) AS INTEGER) AS part, count(*) AS n_rows,
 count(DISTINCT db_id) AS n_databases, min(place) AS first, max(place) AS last FROM mix GROUP BY 1""",
    "corpus_counts": f"""WITH {TRAIN} SELECT count(*) FILTER (WHERE split = 'train') AS num_train,
 count(*) FILTER (WHERE split = 'validation') AS num_val, count(DISTINCT db_id) AS num_databases FROM train""",
    "length_stats": f"""WITH {TRAIN} SELECT round(avg(length(query)), 9) AS avg_query_length,
 round(avg(length(question)), 9) AS avg_question_length FROM train""",
    "histogram_query_length": histogram(TRAIN, "train", "length(query)", 50),
    "histogram_question_length": histogram(LONG, "long_questions", "length(question)", 50),
    "histogram_columns": histogram(
        CATALOG + ", sizes AS (SELECT db_id, count(*) FILTER (WHERE table_idx >= 0) AS n_columns FROM placed GROUP BY db_id)",
        "sizes", "n_columns", 30,
    ),
    "keyword_distribution": f"""WITH {TRAIN}, words AS (SELECT unnest({picked(CORPUS_KEYWORDS, 'query')}) AS keyword FROM train)
SELECT keyword, count(*) AS count FROM words GROUP BY keyword""",
    "schema_size_stats": f"""WITH {CATALOG}, sizes AS (
 SELECT db_id, count(*) FILTER (WHERE table_idx >= 0) AS n_columns FROM placed GROUP BY db_id
) SELECT CAST({len(CATALOG_TABLES)} AS DOUBLE) AS avg_tables, round(avg(n_columns), 9) AS avg_columns FROM sizes""",
}

for _name, _text in REWRITES.items():
    ORACLES[f"rewrite_{_name}"] = f"""WITH {TRAIN},
examples AS (SELECT *, '{_CATEGORY_OF[_name]}' AS category FROM train),
copies AS (SELECT * FROM examples CROSS JOIN (VALUES (1), (2), (3)) AS c(copy)),
made AS (SELECT idx, copy, {_text} AS question FROM copies)
SELECT idx, copy, question FROM made WHERE question IS NOT NULL"""

ORACLES["write_result"] = ORACLES["write_result_models"] = ORACLES["accuracy_by_difficulty"]
ORACLES["read_analysis"] = f"""WITH {DISTRIBUTION} SELECT model_name, category, label, n AS count,
 pct_of_errors AS error_rate, CAST(rank AS INTEGER) AS rank FROM ranked"""
