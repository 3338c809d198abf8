"""JSON helpers on text and VARIANT columns; only the indented layout leaves the JVM."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from paperloom.functions.columns import python_float_sql


_JSON_ENDS = r'(?s)^\s*(\{\s*".*\}|\{\s*\}|\[.*\]|".*"|[tfn\d-][\w.+-]*)\s*$'


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strict_variant(text: Column) -> Column:
    """The text parsed as exactly one JSON value, else null.

    Spark's parser accepts anything after a complete value. Read as the only element of a
    list, a text can end early only at a closing bracket of its own; texts that have one
    must also parse as the only field of an object, which such a bracket would break.
    """
    as_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    whole = ~F.contains(text, F.lit("]")) | as_field.isNotNull()
    # A failing parse is costly, so texts that cannot be JSON by their two ends skip it.
    items = F.when(text.rlike(_JSON_ENDS), F.try_variant_get(as_list, "$", "array<variant>"))
    return bind(items, lambda x: F.when((F.size(x) == 1) & whole, F.get(x, F.lit(0))))


def is_strict_json(text: Column) -> Column:
    return strict_variant(text).isNotNull()


def object_entries(v: Column) -> Column:
    """map<string, variant> of an object, null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def list_items(v: Column) -> Column:
    """array<variant> of a list, null for any other value."""
    return F.try_variant_get(v, "$", "array<variant>")


# The same rules as SQL text on named columns, for long plans: one call builds each.
def kind_sql(t: str) -> str:
    """object, list, string, number, boolean or null, from a VARIANT's type text."""
    return (
        f"CASE WHEN startswith({t}, 'OBJECT') THEN 'object' WHEN startswith({t}, 'ARRAY') THEN 'list' "
        f"WHEN {t} = 'STRING' THEN 'string' WHEN {t} = 'BOOLEAN' THEN 'boolean' WHEN {t} = 'VOID' THEN 'null' "
        f"WHEN {t} IS NOT NULL THEN 'number' END"
    )


def scalar_sql(v: str, t: str) -> str:
    """A scalar of type text ``t`` spelled as Python's ``str`` would, but true/false in lower case.

    Null stays null. Whole numbers keep their spelling, all others are doubles (5.00 reads 5.0).
    """
    double = python_float_sql(f"try_variant_get({v}, '$', 'double')")
    return f"CASE WHEN startswith({t}, 'DECIMAL') OR {t} = 'DOUBLE' THEN {double} ELSE try_variant_get({v}, '$', 'string') END"


def fragment_sql(v: str, t: str) -> str:
    """JSON text of a VARIANT of type text ``t``; a number that is not whole by type keeps its point (5.0)."""
    double = python_float_sql(f"try_variant_get({v}, '$', 'double')")
    return f"CASE WHEN startswith({t}, 'DECIMAL') OR {t} = 'DOUBLE' THEN {double} ELSE to_json({v}) END"


def kind_of(v: Column) -> Column:
    """The kind of a VARIANT; SQL null where there is no value."""
    return bind(F.schema_of_variant(v), lambda t: (
        F.when(t.startswith("OBJECT"), F.lit("object"))
        .when(t.startswith("ARRAY"), F.lit("list"))
        .when(t == "STRING", F.lit("string"))
        .when(t == "BOOLEAN", F.lit("boolean"))
        .when(t == "VOID", F.lit("null"))
        .when(t.isNotNull(), F.lit("number"))
    ))


@F.pandas_udf(T.StringType())
def indented_json(text: pd.Series) -> pd.Series:
    """JSON text laid out with two blanks per level; text that is not JSON stays as it is."""

    def layout(t):
        try:
            return t if t is None else json.dumps(json.loads(t), indent=2)
        except ValueError:
            return t

    return text.map(layout)
