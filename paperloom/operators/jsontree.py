"""JSON trees as leaf rows, and leaf rows as JSON trees.

A walk is a chain of ``explode``s, one per level, over VARIANT columns: the source is read
once, nothing is shuffled, and trees of any shape share one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.json_text import bind, fragment_sql, kind_sql, object_entries, scalar_sql

DEFAULT_DEPTH = 8


OBJECT, LIST = "map<string,variant>", "array<variant>"


def quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def opened_sql(node: str, kind: str) -> str:
    """SQL text of a node's fields or items; null when it is of another kind."""
    return f"try_variant_get({node}, '$', '{kind}')"


def next_level(rows: DataFrame, node: str, others: Sequence[str]) -> DataFrame:
    """One step down: a row per field or item of ``node``; scalars stay.

    Adds ``pos`` and ``key``; ``key`` is null for list items, ``pos`` for scalars. Only the
    entries are built inside the generator, so what a caller derives from them is compiled.
    """
    kept, no_key = quoted(others), "CAST(NULL AS STRING)"
    entries = (
        "CASE WHEN __m IS NOT NULL THEN map_entries(__m) "
        f"WHEN __a IS NOT NULL THEN transform(__a, x -> named_struct('key', {no_key}, 'value', x)) "
        f"ELSE array(named_struct('key', {no_key}, 'value', {node})) END"
    )
    return (
        rows.selectExpr(*kept, node, f"{opened_sql(node, OBJECT)} AS __m", f"{opened_sql(node, LIST)} AS __a")
        .selectExpr(*kept, "__m IS NULL AND __a IS NULL AS __s", f"posexplode({entries}) AS (pos, e)")
        .selectExpr(*kept, "CASE WHEN NOT __s THEN pos END AS pos", "e.key AS key", f"e.value AS {node}")
    )


# The display path after ``next_level``: ``a`` then ``b`` is ``a.b``, a position is ``a[0]``.
# Keys are not escaped.
STEP_PATH = (
    "CASE WHEN key IS NOT NULL THEN concat(coalesce(concat(path, '.'), ''), key) "
    "WHEN pos IS NOT NULL THEN concat(coalesce(path, ''), '[', pos, ']') ELSE path END AS path"
)

# The unambiguous path: ``/`` starts a step, ``#`` a list position; both, and ``~``, are
# written as codes inside keys.
POINTER_STEP = "concat('/', replace(replace(replace({0}, '~', '~0'), '/', '~1'), '#', '~2'))"


def pointer_key(key: Column) -> Column:
    """A key as written in the unambiguous path."""
    return F.replace(F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.lit("#"), F.lit("~2"))


def is_container(t: str) -> str:
    """SQL text: whether a type text is that of an object or a list."""
    return f"(startswith({t}, 'OBJECT') OR startswith({t}, 'ARRAY'))"


def only_leaves(node: str, t: str) -> str:
    """SQL filter dropping empty containers."""
    return f"NOT ({is_container(t)} AND to_json({node}) IN ('{{}}', '[]'))"


def nesting_sql(text: str) -> str:
    """SQL text: how deep the containers of a JSON text nest, by one scan over its brackets outside strings."""
    strings = r'''"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"'''
    brackets = f"translate(regexp_replace(regexp_replace({text}, '{strings}', ''), '[^\\\\[\\\\]{{}}]+', ''), '{{}}', '[]')"
    step = "(a, c) -> named_struct('d', a.d + if(c = '[', 1, -1), 'm', greatest(a.m, a.d + if(c = '[', 1, -1)))"
    return f"aggregate(filter(split({brackets}, ''), c -> c <> ''), named_struct('d', 0, 'm', 0), {step}, a -> a.m)"


def deepened(rows: DataFrame, node: str, element: str, children: str) -> DataFrame:
    """Rows that still hold a container below the unrolled levels, opened to their last level.

    ``element`` is a ``named_struct`` of the row's columns, ``children`` an array of such structs
    for the struct ``x``. Other rows pass as they are. There are as many passes as the containers nest, so there
    is no limit, and a row's cost is its size times its depth; only rows that are so deep pay it.
    """
    filled = f"{is_container(f'schema_of_variant({node})')} AND to_json({node}) NOT IN ('{{}}', '[]')"
    opened = (
        f"aggregate(sequence(1, {nesting_sql(f'to_json({node})')}), array({element}), "
        f"(__acc, __i) -> flatten(transform(__acc, x -> {children})))"
    )
    return rows.selectExpr(f"explode(CASE WHEN {filled} THEN {opened} ELSE array({element}) END) AS __n").select("__n.*")


def _deeper_leaf(kept: Sequence[str]) -> tuple[str, str]:
    """One row of a walk as a struct, and the structs one level below the struct ``x``."""
    element = ", ".join(f"'{k.strip('`')}', {k}" for k in [*kept, "path", "pointer", "ords", "node"])
    same = ", ".join(f"'{k.strip('`')}', x.{k}" for k in kept)
    lead = f"named_struct({same}{', ' if same else ''}"
    field = POINTER_STEP.format("e.key")
    children = (
        f"CASE WHEN try_variant_get(x.node, '$', '{OBJECT}') IS NOT NULL AND to_json(x.node) <> '{{}}' THEN "
        f"transform(map_entries(try_variant_get(x.node, '$', '{OBJECT}')), (e, i) -> {lead}"
        f"'path', concat(coalesce(concat(x.path, '.'), ''), e.key), 'pointer', concat(x.pointer, {field}), "
        "'ords', concat(x.ords, array(i)), 'node', e.value)) "
        f"WHEN try_variant_get(x.node, '$', '{LIST}') IS NOT NULL AND to_json(x.node) <> '[]' THEN "
        f"transform(try_variant_get(x.node, '$', '{LIST}'), (v, i) -> {lead}"
        "'path', concat(coalesce(x.path, ''), '[', i, ']'), 'pointer', concat(x.pointer, '/#', i), "
        "'ords', concat(x.ords, array(i)), 'node', v)) ELSE array(x) END"
    )
    return f"named_struct({element})", children


def leaf_walk_sql(text: str) -> str:
    """SQL text of an array of structs ``(path, pointer, ords, node)``: all leaves and empty containers of a JSON text."""
    root = (
        "named_struct('path', CAST(NULL AS STRING), 'pointer', '', 'ords', CAST(array() AS ARRAY<INT>), "
        f"'node', try_parse_json({text}))"
    )
    children = _deeper_leaf([])[1]
    return (
        f"CASE WHEN try_parse_json({text}) IS NOT NULL THEN aggregate(sequence(0, {nesting_sql(text)}), array({root}), "
        f"(__acc, __i) -> flatten(transform(__acc, x -> {children}))) END"
    )


def json_leaves(df: DataFrame, column: str, keys: Sequence[str], max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """Leaf rows (keys, path, pointer, ords, type, value, json) of a VARIANT column.

    ``path`` is the display spelling (``a[0].b``), ``pointer`` an unambiguous one to join
    on, ``ords`` the position at each level (object fields in key order), ``json`` the leaf
    as JSON text. Empty containers have no leaf. ``max_depth`` levels are unrolled in the plan;
    what lies deeper is opened row by row, so trees have no depth limit. Null trees have no leaves:
    ``unreadable_json`` lists texts that did not parse.
    """
    kept = quoted(keys)
    rows = df.filter(F.col(column).isNotNull()).selectExpr(
        *kept, "CAST(NULL AS STRING) AS path", "'' AS pointer", "CAST(array() AS ARRAY<INT>) AS ords", f"`{column}` AS node",
    )
    pointer = (
        f"CASE WHEN key IS NOT NULL THEN concat(pointer, {POINTER_STEP.format('key')}) "
        "WHEN pos IS NOT NULL THEN concat(pointer, '/#', pos) ELSE pointer END AS pointer"
    )
    ords = "CASE WHEN pos IS NOT NULL THEN concat(ords, array(pos)) ELSE ords END AS ords"
    for _ in range(max_depth):
        rows = next_level(rows, "node", [*keys, "path", "pointer", "ords"]).selectExpr(*kept, STEP_PATH, pointer, ords, "node")
    rows = deepened(rows, "node", *_deeper_leaf(kept))
    return (
        rows.selectExpr(*kept, "path", "pointer", "ords", "node", "schema_of_variant(node) AS __t")
        .filter(only_leaves("node", "__t"))
        .selectExpr(
            *kept, "coalesce(path, '') AS path", "pointer", "ords", f"{kind_sql('__t')} AS type",
            f"{scalar_sql('node', '__t')} AS value", f"{fragment_sql('node', '__t')} AS json",
        )
    )


def unreadable_json(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, column, error) for every JSON text that does not parse and therefore has no tree.

    A repeated key is an error unless the session keeps the last one (``keep_last_duplicate_key``).
    """
    problems = F.array(*[
        F.when(
            F.col(c).isNotNull() & F.try_parse_json(c).isNull(),
            F.struct(F.lit(c).alias("column"), F.concat(F.lit("not JSON, or beyond what a VARIANT holds: "), F.left(c, F.lit(80))).alias("error")),
        ) for c in columns
    ])
    found = F.filter(problems, lambda p: p.isNotNull())
    return df.select(*keys, F.explode(found).alias("p")).select(*keys, "p.*")


def json_leaves_recursive(spark, view: str, column: str, key: str) -> DataFrame:
    """The same leaf paths by a recursive query over ``variant_explode``, for SQL users.

    Depth is bounded by the session's recursion limits only; ``json_leaves`` needs none.
    """
    return spark.sql(f"""
        WITH RECURSIVE walk({key}, path, node) AS (
          SELECT {key}, CAST(NULL AS STRING), {column} FROM {view}
          UNION ALL
          SELECT w.{key},
            CASE WHEN e.key IS NULL THEN concat(coalesce(w.path, ''), '[', e.pos, ']')
                 WHEN w.path IS NULL THEN e.key ELSE concat(w.path, '.', e.key) END,
            e.value
          FROM walk w, LATERAL variant_explode(w.node) AS e(pos, key, value)
        )
        SELECT {key}, coalesce(path, '') AS path, to_json(node) AS json FROM walk
        WHERE schema_of_variant(node) NOT LIKE 'OBJECT%' AND schema_of_variant(node) NOT LIKE 'ARRAY%'
    """)


def _quoted(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def assemble_json(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON text per key from (keys, pointer, json) fragments; inverse of the walk.

    A record's fragments are put in order once, by the steps of their paths. Then each one closes the containers that it has
    left since the one before, and opens its own: a single pass, whatever the depth. Object fields come in key order.
    """
    steps = F.transform(F.slice(F.split("pointer", "/"), 2, 1 << 30), lambda s: F.struct(
        F.when(F.startswith(s, F.lit("#")), F.substring(s, F.lit(2), F.length(s)).try_cast("int")).alias("i"),
        F.when(~F.startswith(s, F.lit("#")), _decoded(s)).alias("k")))
    rows = nodes.select(*keys, F.struct(F.when(F.col("pointer") == "", F.array().cast("array<struct<i:int,k:string>>")).otherwise(steps).alias("s"), F.col("json").alias("v")).alias("p"))
    ordered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("p"))
    label = lambda s: F.when(s["k"].isNull(), F.lit("")).otherwise(F.concat(_quoted(s["k"]), F.lit(":")))
    opened = lambda part: F.array_join(F.transform(part, lambda s: F.concat(F.when(s["k"].isNull(), F.lit("[")).otherwise(F.lit("{")), label(s))), "")
    closed = lambda part: F.array_join(F.transform(F.reverse(part), lambda s: F.when(s["k"].isNull(), F.lit("]")).otherwise(F.lit("}"))), "")
    rest = lambda s, n: F.slice(s, n, F.greatest(F.size(s) - n + 1, F.lit(0)))

    def between(x: Column, before: Column) -> Column:
        same = F.zip_with(x["s"], before, lambda a, b: a.eqNullSafe(b))
        parted = F.array_position(same, False).cast("int")  # 1-based step at which the two paths part
        return bind(F.when(parted > 0, parted).otherwise(F.size("p")), lambda n: F.concat(
            closed(rest(before, n + 1)), F.lit(","), label(F.get(x["s"], n - 1)), opened(rest(x["s"], n + 1)), x["v"]))

    def written(x: Column, i: Column) -> Column:
        return F.when(i == 0, F.concat(opened(x["s"]), x["v"])).otherwise(bind(F.get(F.col("p"), i - 1)["s"], lambda before: between(x, before)))

    last = F.get("p", F.size("p") - 1)["s"]
    return ordered.select(*keys, F.concat(F.array_join(F.transform("p", written), ""), closed(last)).alias("json"))


def _decoded(step: Column) -> Column:
    return F.replace(F.replace(F.replace(step, F.lit("~2"), F.lit("#")), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def leaves_to_json(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaf rows back to one JSON text per key."""
    return assemble_json(leaves, keys)


def template_paths(df: DataFrame, column: str, keys: Sequence[str], max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """Leaf paths of a template, list positions generalised to ``[*]``.

    A template is an example tree, or a JSON Schema (an object with ``properties``), whose
    leaves are its typed scalars.
    """
    is_schema = F.col("__schema")
    fields = F.map_keys(object_entries(F.col(column)))
    marked = df.withColumn("__schema", F.coalesce(F.array_contains(fields, "properties"), F.lit(False)))
    leaves = json_leaves(marked, column, [*keys, "__schema"], max_depth)
    typed = F.col("pointer").rlike(r"^(/properties/[^/]+|/items)+/type$") & ~F.col("value").isin("object", "array")
    named = F.regexp_replace(F.regexp_replace("pointer", "/properties/([^/]+)", ".$1"), "/items", "[*]")
    readable = F.regexp_replace(F.regexp_replace(named, "/type$", ""), r"^\.", "")
    for code, char in (("~2", "#"), ("~1", "/"), ("~0", "~")):
        readable = F.replace(readable, F.lit(code), F.lit(char))
    plain = F.regexp_replace("path", r"\[\d+\]", "[*]")
    return (
        leaves.filter(~is_schema | typed)
        .select(*keys, F.when(is_schema, readable).otherwise(plain).alias("path"))
        .distinct()
    )
