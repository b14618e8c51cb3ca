"""Reading object and column references out of view texts, with column expressions only.

Each text is handled within its row by patterns and array functions. Stated limits: table
names after a derived table in a comma list are missed (``may_miss_sources`` reports such
texts), so is a FROM inside a function call whose first argument itself contains a call.
Select lists aren't taken apart: column mappings start from rows of select items.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = r'(?:"[^"]++"|[\p{L}_#$][\p{L}\p{M}\p{N}_#$]*+)'
_NAME = rf"{_ID}(?:\s*\.\s*{_ID})*+(?!\s*\()"
# Words that end a table reference and so are no aliases.
_CLAUSES = (
    "ON|USING|WHERE|GROUP|HAVING|ORDER|QUALIFY|UNION|INTERSECT|EXCEPT|MINUS|LEFT|RIGHT|FULL|INNER|OUTER|CROSS"
    "|JOIN|NATURAL|WINDOW|LIMIT|SAMPLE|WITH|SELECT|FROM|AS|SET|LATERAL"
)
_ALIAS = rf"(?:\s+(?:AS\s+)?(?!(?:{_CLAUSES})\b){_ID})?"
_ITEM = rf"{_NAME}{_ALIAS}"
_QUERY = r"(?:SELECT|SEL|WITH|VALUES)\b"
_TABLES = rf"(?i)\b(?:FROM|JOIN)\b[\s(]+(?!{_QUERY})({_ITEM}(?:\s*,\s*{_ITEM})*)"
# A derived table, and somewhere after the first one a closing parenthesis with an alias and a comma.
_DERIVED = rf"(?i)(?:\bFROM|\bJOIN|,)\s*+\(++\s*+{_QUERY}"
_LIST_GOES_ON = rf"(?i)\)\s*+(?:AS\s++)?(?!(?:{_CLAUSES})\b){_ID}\s*+(?:\([^()]*+\)\s*+)?,"
_CTE = rf"(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)({_ID})\s*(?:\([^()]*\))?\s*AS\s*\("
_COMMENTS = r"""(?s)('[^']*+(?:''[^']*+)*+'|"[^"]*+")|--[^\n]*+|/\*.*?\*/"""
_LITERAL = r"'[^']*+(?:''[^']*+)*+'"
_FROM_IN_CALL = r"(?i)\b(EXTRACT|TRIM|SUBSTRING|OVERLAY)\s*\([^()]*?\bFROM\b"
_CALL_TYPE = r"(?i)\bAS\s+[A-Za-z]\w*(?:\s*\([\d\s,]*\))?"
# Words in an expression that are not column names.
_WORDS = [
    "ALL", "AND", "ANY", "AS", "ASC", "BETWEEN", "BOTH", "BY", "CASE", "CURRENT", "CURRENT_DATE",
    "CURRENT_TIMESTAMP", "DATE", "DAY", "DESC", "DISTINCT", "ELSE", "END", "EXISTS", "FALSE", "FOLLOWING",
    "FORMAT", "FROM", "HOUR", "IN", "INTERVAL", "IS", "LEADING", "LIKE", "MINUTE", "MONTH", "NOT", "NULL", "OR",
    "ORDER", "OVER", "PARTITION", "PRECEDING", "RANGE", "ROW", "ROWS", "SECOND", "SELECT", "THEN", "TIME",
    "TIMESTAMP", "TO", "TRAILING", "TRUE", "UNBOUNDED", "USER", "USING", "WHEN", "WHERE", "YEAR",
]


def strip_comments(ddl: Column) -> Column:
    """Comments become blanks; quoted text stays."""
    return F.regexp_replace(ddl, _COMMENTS, "$1 ")


def _code(ddl: Column) -> Column:
    """Text without comments, literals and FROM keywords that belong to a function call."""
    bare = F.regexp_replace(strip_comments(ddl), _LITERAL, "''")
    return F.regexp_replace(bare, _FROM_IN_CALL, "$1(")


def _plain(part: Column) -> Column:
    return F.regexp_replace(part, '^"|"$', "")


def _parts(name: Column) -> Column:
    """The parts of a dotted name; what stands in quotes is one part, blanks and dots included."""
    return F.transform(F.regexp_extract_all(name, F.lit(rf"{_ID}|\*"), 0), _plain)


def table_items(ddl: Column) -> Column:
    """Array of (db, name, alias) for each table reference, in the case of the text."""
    lists = F.regexp_extract_all(_code(ddl), F.lit(_TABLES), 1)
    items = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit(f"(?i){_ITEM}"), 0)))

    def entry(item: Column) -> Column:
        parts = _parts(F.regexp_extract(item, f"(?i)^({_NAME})", 1))
        alias = _plain(F.regexp_extract(item, rf"(?i)^{_NAME}\s+(?:AS\s+)?({_ID})$", 1))
        return F.struct(
            F.try_element_at(parts, F.when(F.size(parts) > 1, F.lit(-2)).otherwise(F.lit(2))).alias("db"),
            F.element_at(parts, -1).alias("name"),
            F.when(alias != "", alias).alias("alias"),
        )

    return F.transform(items, lambda s: entry(F.trim(s)))


def may_miss_sources(ddl: Column) -> Column:
    """Whether a comma list may go on after a derived table, which the patterns don't read.

    Errs on the side of reporting: a scalar subquery with an alias in a select list counts too.
    """
    code = _code(ddl)
    first = F.regexp_instr(code, F.lit(_DERIVED))
    rest = F.substring(code, first, F.length(code))
    return F.coalesce((first > 0) & rest.rlike(_LIST_GOES_ON), F.lit(False))


def cte_names(ddl: Column) -> Column:
    return F.transform(F.regexp_extract_all(_code(ddl), F.lit(_CTE), 1), lambda n: F.upper(_plain(n)))


def source_objects(ddl: Column, self_db: Column, self_name: Column) -> Column:
    """Distinct upper-cased (db, name) a view reads, without itself and its own CTEs."""
    upper = F.transform(
        table_items(ddl), lambda t: F.struct(F.upper(t["db"]).alias("db"), F.upper(t["name"]).alias("name"))
    )
    ctes = cte_names(ddl)

    def is_source(t: Column) -> Column:
        bare = t["db"].isNull()
        itself = (t["name"] == F.upper(self_name)) & (bare | (t["db"] == F.upper(F.coalesce(self_db, F.lit("")))))
        return ~F.coalesce(itself, F.lit(False)) & ~(bare & F.array_contains(ctes, t["name"]))

    return F.array_distinct(F.filter(upper, is_source))


def is_column(expression: Column) -> Column:
    """Whether an expression is nothing but a column reference."""
    name = rf"^{_ID}(?:\s*\.\s*(?:{_ID}|\*))*$"
    return expression.rlike(name) & ~F.upper(expression).isin(_WORDS)


def column_refs(expression: Column) -> Column:
    """Distinct (alias, column) references of an expression; alias is null where none is given."""
    # Tables of a subquery are no columns; FROM inside a call is dropped before they are cut.
    bare = F.regexp_replace(_code(expression), _TABLES, " ")
    bare = F.regexp_replace(bare, _CALL_TYPE, " ")
    names = F.regexp_extract_all(
        bare, F.lit(rf"(?<![\w.$#\"])({_ID}(?:\s*\.\s*(?:{_ID}|\*))*+)(?!\s*\()"), 1
    )

    def entry(name: Column) -> Column:
        parts = _parts(name)
        return F.struct(
            F.try_element_at(parts, F.when(F.size(parts) > 1, F.lit(-2)).otherwise(F.lit(2))).alias("alias"),
            F.element_at(parts, -1).alias("column"),
        )

    words = F.filter(F.transform(names, entry), lambda r: r["alias"].isNotNull() | ~F.upper(r["column"]).isin(_WORDS))
    return F.array_distinct(words)
