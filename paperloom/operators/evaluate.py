"""Field-by-field evaluation of extracted JSON against ground truth."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions import scoring as S
from paperloom.functions.json_text import object_entries, scalar_sql
from paperloom.operators.jsontree import (
    DEFAULT_DEPTH, LIST, OBJECT, STEP_PATH, deepened, is_container, next_level, only_leaves, opened_sql, quoted, unreadable_json,
)
from paperloom.session import keep_last_duplicate_key


@dataclass(frozen=True)
class Evaluator:
    """A scorer under the name its configuration and results use.

    ``score`` builds a Column from (ground truth, actual, options): built-in functions, or a
    ``pandas_udf`` of the user. ``attach`` may add the score to a frame instead, where that
    lets intermediate results be computed once.
    """

    name: str
    score: S.Scorer
    default_config: Mapping = field(default_factory=dict)
    attach: Callable[..., DataFrame] | None = None


EXACT = Evaluator("CustomStringEvaluator", S.match_score)
FUZZY = Evaluator("FuzzStringEvaluator", S.fuzzy_score, attach=S.with_fuzzy_score)
DEFAULT_EVALUATORS = (EXACT, FUZZY)

_REGISTRY: dict[str, Evaluator] = {e.name: e for e in DEFAULT_EVALUATORS}


def register_evaluator(evaluator: Evaluator) -> Evaluator:
    """Make an evaluator available by name."""
    _REGISTRY[evaluator.name] = evaluator
    return evaluator


def evaluators(*names: str) -> list[Evaluator]:
    unknown = [n for n in names if n not in _REGISTRY]
    if unknown:
        raise ValueError(f"unknown evaluators {unknown}; known: {sorted(_REGISTRY)}")
    return [_REGISTRY[n] for n in names]


def _as_variant(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("variant")
    c = F.col(name)
    return c if dict(df.dtypes)[name] == "variant" else F.try_parse_json(c)


def aligned_leaves(items: DataFrame, keys: Sequence[str], max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """Every ground-truth leaf beside the actual value and configuration at the same path.

    ``items`` has ``ground_truth``, ``actual`` and optionally ``eval_schema`` as JSON text or
    VARIANT. The three trees are walked together, one ``explode`` per level, so there is no
    join and no shuffle. A missing path, a short list or another type gives null; extra
    actual fields are ignored. Rows: (keys, path, gt, actual, config). ``max_depth`` levels are unrolled in the
    plan; deeper fields are opened row by row. A repeated key keeps its last value, whatever the session was set
    to. Items whose ground truth is not JSON have no fields: ``unreadable_items`` lists them.
    """
    keep_last_duplicate_key(items.sparkSession)
    rows = items.select(
        *keys,
        F.lit(None).cast("string").alias("path"),
        _as_variant(items, "ground_truth").alias("g"),
        _as_variant(items, "actual").alias("a"),
        _as_variant(items, "eval_schema").alias("s"),
    ).filter(F.col("g").isNotNull())

    kept = quoted(keys)
    opened = [f"{opened_sql(x, k)} AS {x}{n}" for x in "as" for n, k in (("m", OBJECT), ("l", LIST))]
    beside = [
        f"CASE WHEN key IS NOT NULL THEN try_element_at({x}m, key) WHEN pos IS NOT NULL THEN get({x}l, pos) ELSE {x} END AS {x}"
        for x in "as"
    ]
    for _ in range(max_depth):
        # The other two trees are opened once per container, before the fields are spread.
        rows = rows.selectExpr(*kept, "path", "g", "a", "s", *opened)
        rows = next_level(rows, "g", [*keys, "path", "a", "s", "am", "al", "sm", "sl"]).selectExpr(*kept, STEP_PATH, "g", *beside)
    rows = deepened(rows, "g", *_deeper_field(kept))
    return (
        rows.selectExpr(*kept, "path", "g", "a", "s", "schema_of_variant(g) AS __gt", "schema_of_variant(a) AS __at")
        .filter(only_leaves("g", "__gt"))
        .selectExpr(
            *kept, "coalesce(path, '') AS path", f"{scalar_sql('g', '__gt')} AS gt",
            f"CASE WHEN NOT {is_container('__at')} THEN {scalar_sql('a', '__at')} END AS actual", "s AS config",
        )
    )


def _deeper_field(kept: Sequence[str]) -> tuple[str, str]:
    """One row of the joint walk as a struct, and the structs one level below the struct ``x``."""
    element = ", ".join(f"'{k.strip('`')}', {k}" for k in [*kept, "path", "g", "a", "s"])
    same = ", ".join(f"'{k.strip('`')}', x.{k}" for k in kept)
    lead = f"named_struct({same}{', ' if same else ''}"
    field = ", ".join(f"'{c}', try_element_at(try_variant_get(x.{c}, '$', '{OBJECT}'), e.key)" for c in "as")
    item = ", ".join(f"'{c}', get(try_variant_get(x.{c}, '$', '{LIST}'), i)" for c in "as")
    children = (
        f"CASE WHEN try_variant_get(x.g, '$', '{OBJECT}') IS NOT NULL AND to_json(x.g) <> '{{}}' THEN "
        f"transform(map_entries(try_variant_get(x.g, '$', '{OBJECT}')), e -> {lead}"
        f"'path', concat(coalesce(concat(x.path, '.'), ''), e.key), 'g', e.value, {field})) "
        f"WHEN try_variant_get(x.g, '$', '{LIST}') IS NOT NULL AND to_json(x.g) <> '[]' THEN "
        f"transform(try_variant_get(x.g, '$', '{LIST}'), (v, i) -> {lead}"
        f"'path', concat(coalesce(x.path, ''), '[', i, ']'), 'g', v, {item})) ELSE array(x) END"
    )
    return f"named_struct({element})", children


def unreadable_items(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, column, error) for items with a JSON text that does not parse, in any of the three columns."""
    keep_last_duplicate_key(items.sparkSession)
    texts = [c for c in ("ground_truth", "actual", "eval_schema") if dict(items.dtypes).get(c) == "string"]
    return unreadable_json(items, texts, keys)


def compare_leaves(gt: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same pairing for leaf tables stored apart: ground truth left-joined with actual by path."""
    on = [*keys, "pointer"]
    found = actual.select(*on, F.col("value").alias("actual"))
    return gt.select(*on, "path", F.col("value").alias("gt")).join(found, on, "left").drop("pointer")


def leaf_config(leaves: DataFrame, schema_leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add each leaf's evaluator configuration from a table (keys, path, config); absent is null."""
    return leaves.join(schema_leaves.select(*keys, "path", "config"), [*keys, "path"], "left")


def apply_evaluators(
    leaves: DataFrame, keys: Sequence[str], chosen: Sequence[Evaluator] = DEFAULT_EVALUATORS
) -> DataFrame:
    """Leaf rows times evaluators: (keys, evaluator, path, score). One pass, no join."""
    has_config = "config" in leaves.columns
    scored = leaves
    for i, e in enumerate(chosen):
        own = F.try_element_at(object_entries(F.col("config")), F.lit(e.name)) if has_config else F.lit(None).cast("variant")
        scored = scored.withColumn("__o", S.options_of(own, e.default_config))
        sides = F.col("gt"), F.col("actual"), F.col("__o")
        if e.attach:
            scored = e.attach(scored, f"__s{i}", *sides)
        else:
            scored = scored.withColumn(f"__s{i}", e.score(*sides).cast("double"))
    rows = F.array(*[
        F.struct(F.lit(e.name).alias("evaluator"), F.col(f"__s{i}").alias("score")) for i, e in enumerate(chosen)
    ])
    return scored.select(*keys, "path", F.explode(rows).alias("r")).select(*keys, "r.evaluator", "path", "r.score")


def evaluator_ratio(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Score sum over number compared, per group and evaluator; 0 when nothing was compared."""
    ratio = F.when(F.count("score") > 0, F.sum("score") / F.count("score")).otherwise(F.lit(0.0))
    return scores.groupBy(*by, "evaluator").agg(
        F.count("score").alias("compared"), F.sum("score").alias("total_score"), ratio.alias("ratio")
    )


def evaluate_json(
    items: DataFrame,
    keys: Sequence[str],
    chosen: Sequence[Evaluator] = DEFAULT_EVALUATORS,
    max_depth: int = DEFAULT_DEPTH,
) -> DataFrame:
    """Scores of every field: (keys, evaluator, path, score)."""
    return apply_evaluators(aligned_leaves(items, keys, max_depth), keys, chosen)


def wide_results(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per item: map of ``Evaluator.path`` to score, with ``Evaluator.ratio`` added."""
    totals = evaluator_ratio(scores, keys).select(
        *keys, F.concat("evaluator", F.lit(".ratio")).alias("name"), F.col("ratio").alias("score")
    )
    fields = scores.select(*keys, F.concat("evaluator", F.lit("."), "path").alias("name"), "score")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "score"))))
    return fields.union(totals).groupBy(*keys).agg(entries.alias("results"))


def run_metrics(scores: DataFrame) -> DataFrame:
    """Mean score per evaluator and field over all items."""
    return scores.groupBy("evaluator", "path").agg(F.avg("score").alias("value"))


def field_average(runs: DataFrame, prefix: str = "json_evaluator.CustomStringEvaluator.") -> DataFrame:
    """Mean of each field over runs, the metric prefix removed, rounded half to even."""
    name = F.substring(F.col("metric"), F.lit(len(prefix) + 1), F.length("metric"))
    return (
        runs.filter(F.startswith("metric", F.lit(prefix)))
        .groupBy(name.alias("field"))
        .agg(F.bround(F.avg("value"), 1).alias("average"))
    )
