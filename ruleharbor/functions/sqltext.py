"""Reading tables, columns and shape out of SQL request texts.

A text is cut into tokens first, so that words in strings, comments and quoted names are not taken for SQL; what belongs
to the first SELECT list is told by the depth of brackets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleharbor.functions.expr import let
from ruleharbor.functions.fixed_values import EDGE_SPACE
from ruleharbor.functions.text import strip

_STRING = r"'[^']*+(?:''[^']*+)*+'?"
_COMMENT = r"--[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"?|`[^`]*+`?'
# Comments, strings, quoted names, numbers, words, and any other mark by itself; what a text leaves open runs to its end.
TOKEN_PATTERN = rf"{_COMMENT}|{_STRING}|{_QUOTED}|\d[\w.]*+|(?U:[\w$]++)|\S"
NOT_CODE_PATTERN = rf"({_QUOTED})|{_STRING}|{_COMMENT}"
AGGREGATES = ("count", "sum", "avg", "min", "max", "group_concat")
_BEFORE_TABLE = ("from", "join", "into", "update")
_FROM_INSIDE = ("extract", "substring", "trim", "overlay", "position")  # functions with a FROM of their own
_ENDS = ("from", "union", "except", "intersect", ";")
_NO_NAMES = ("end", "null", "true", "false", "distinct", "as")
_LIST = "struct<phase:int,base:int,depth:int,item:array<string>,items:array<array<string>>>"


def normalise_sql(query: Column) -> Column:
    """Trimmed, without closing semicolons, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(F.rtrim(strip(query), F.lit(";"))), r"\s+", " ")


def sql_tokens(query: Column) -> Column:
    """The tokens of a text in order, comments left out. Strings and quoted names are one token each, quotes included."""
    found = F.regexp_extract_all(query, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: ~(t.startswith("--") | t.startswith("/*")))


def bare_sql(query: Column) -> Column:
    """The text without comments and strings."""
    return F.regexp_replace(query, NOT_CODE_PATTERN, "$1 ")


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _is_quoted(token: Column) -> Column:
    return token.startswith('"') | token.startswith("`")


def _is_name(token: Column) -> Column:
    return _is_quoted(token) | token.rlike(r"^[\p{L}_$]")


def _name(token: Column) -> Column:
    inside = F.regexp_replace(token, r'^["`]|["`]$', "")
    return F.lower(F.when(token.startswith('"'), F.replace(inside, F.lit('""'), F.lit('"'))).otherwise(inside))


def tables_named(query: Column) -> Column:
    """Tables after FROM, JOIN, INTO or UPDATE, at any depth: lower case, each once, in order. Of ``a.b`` it is ``b``."""

    def found(tokens: Column) -> Column:
        at = lambda i: F.get(tokens, i)
        low = lambda i: F.lower(at(i))

        def named(token: Column, i: Column) -> Column:
            # FROM as in EXTRACT(YEAR FROM x) and TRIM(FROM x).
            inside = ((low(i - 3) == "(") & low(i - 4).isin(*_FROM_INSIDE)) | ((low(i - 2) == "(") & low(i - 3).isin(*_FROM_INSIDE))
            after = low(i - 1).isin(*_BEFORE_TABLE) & ~F.coalesce(inside, F.lit(False))
            # The last of up to three parts joined by dots.
            second = F.when(at(i + 1) == ".", at(i + 2))
            third = F.when(second.isNotNull() & (at(i + 3) == "."), at(i + 4))
            return F.when(after & _is_name(token), _name(F.coalesce(third, second, token)))

        return F.array_compact(F.transform(tokens, named))

    names = let(sql_tokens(query), found)
    return F.array_distinct(F.filter(names, lambda n: ~n.isin("select", "where", "set")))


def select_items(query: Column) -> Column:
    """The items of the first SELECT list, each as its tokens; NULL where no FROM ends the list."""

    def step(state: Column, token: Column) -> Column:
        low, phase, depth = F.lower(token), state["phase"], state["depth"]
        after = depth + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        here = depth == state["base"]
        begins = (phase == 0) & (low == "select")
        ends = (phase == 1) & ((here & low.isin(*_ENDS)) | (after < state["base"]))
        cuts = (phase == 1) & here & (token == ",")
        idle = (F.size(state["item"]) == 0) & (F.size(state["items"]) == 0) & low.isin("distinct", "all")
        return F.struct(
            F.when(begins, 1).when(ends, F.when(low == "from", 2).otherwise(3)).otherwise(phase).alias("phase"),
            F.when(begins, depth).otherwise(state["base"]).alias("base"),
            after.alias("depth"),
            F.when(ends | cuts, _no_texts()).when((phase == 1) & ~idle, F.array_append(state["item"], token)).otherwise(
                state["item"]).alias("item"),
            F.when(ends | cuts, F.array_append(state["items"], state["item"])).otherwise(state["items"]).alias("items"),
        ).cast(_LIST)

    start = F.struct(
        F.lit(0).alias("phase"), F.lit(0).alias("base"), F.lit(0).alias("depth"), _no_texts().alias("item"),
        F.array().cast("array<array<string>>").alias("items")).cast(_LIST)
    return F.aggregate(sql_tokens(query), start, step, lambda state: F.when(state["phase"] == 2, state["items"]))


def columns_selected(query: Column) -> Column:
    """Column names of the first SELECT list, lower case; ``['*']`` for SELECT *, empty for none.

    An item gives its quoted names or its last word, so an alias where there is one; an aggregate of ``*`` gives none.
    """

    def names(item: Column) -> Column:
        counted = F.lower(F.get(item, F.lit(0))).isin(*AGGREGATES) & (F.get(item, F.lit(1)) == "(") & F.array_contains(item, "*")
        quoted = F.filter(item, _is_quoted)
        words = F.filter(item, lambda t: _is_name(t) & ~F.lower(t).isin(*_NO_NAMES))
        last = F.when(F.get(item, F.size(item) - 1) == "*", _no_texts()).otherwise(
            F.slice(words, F.greatest(F.size(words), F.lit(1)), F.lit(1)))
        found = F.transform(F.when(F.size(quoted) > 0, quoted).otherwise(last), _name)
        return F.when(F.coalesce(counted, F.lit(False)) | (F.size(item) == 0), _no_texts()).otherwise(found)

    star = F.array(F.array(F.lit("*")))
    found = let(select_items(query), lambda items: F.when(items == star, F.array(F.lit("*"))).otherwise(
        F.flatten(F.transform(items, names))))
    return F.coalesce(found, _no_texts())


def has_where(query: Column) -> Column:
    return bare_sql(query).rlike(r"(?i)\bWHERE\b")


def has_aggregation(query: Column) -> Column:
    return bare_sql(query).rlike(r"(?i)\b(COUNT|SUM|AVG|MIN|MAX|GROUP\s+BY)\b")


def is_select_star(query: Column) -> Column:
    return bare_sql(query).rlike(r"(?i)\bSELECT\s+\*")


def is_read_only(query: Column) -> Column:
    return F.ltrim(bare_sql(query), F.lit(EDGE_SPACE)).rlike(r"(?i)^(SELECT|WITH)\b")
