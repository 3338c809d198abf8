"""Model responses: strict parsing, truncation signs, ordered repairs and classification.

Everything is a chain of text expressions; whether a text is exactly one JSON value is also
decided inside the JVM (see ``strict_variant``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.columns import preview
from paperloom.functions.json_text import bind, strict_variant
from paperloom.session import keep_last_duplicate_key

Fix = Callable[[Column], Column]

# The syntax fixes as (pattern, replacement), in the order they apply. They
# quote single-quoted names and values, drop commas before a closing bracket, and quote bare
# names and bare word values. (?U) gives \w and \s their Unicode meaning.
SYNTAX_FIXES = [
    (r"(?U)'(\w+)':", '"$1":'),
    (r"(?U): '([^']*?)'(?=\s*[,}\]])", ': "$1"'),
    (r"(?U),(\s*[}\]])", "$1"),
    (r"(?U)(\w+):", '"$1":'),
    (r"(?U): ([A-Za-z][A-Za-z0-9\s]*?)(?=\s*[,}\]])", ': "$1"'),
]
RAW_PREVIEW = 1000
FENCE = "```"


def strip_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_fence(c: Column) -> Column:
    """Drop a leading code fence, with or without its language, and a trailing one."""
    opened = F.regexp_replace(strip_blank(c), "^```(json)?", "")
    return strip_blank(F.regexp_replace(opened, "```$", ""))


def outermost(c: Column, open_: str, close: str) -> Column:
    """Text from the first opening to the last closing bracket; unchanged where there is no such span."""
    def span(text):
        found = F.regexp_extract(text, rf"(?s)\{open_}.*\{close}", 0)
        return bind(found, lambda f: F.when(f == "", text).otherwise(f))

    return bind(c, span)


def fix_syntax(c: Column) -> Column:
    for pattern, replacement in SYNTAX_FIXES:
        c = F.regexp_replace(c, pattern, replacement)
    return c


# Repairs by name, in the order they are tried. Add to a copy to plug in another one.
REPAIRS: list[tuple[str, Fix]] = [
    ("fence", strip_fence),
    ("object", lambda c: outermost(strip_fence(c), "{", "}")),
    ("array", lambda c: outermost(strip_fence(c), "[", "]")),
    ("object_syntax", lambda c: fix_syntax(outermost(strip_fence(c), "{", "}"))),
    ("array_syntax", lambda c: fix_syntax(outermost(strip_fence(c), "[", "]"))),
]


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def truncation_signs(content: Column) -> Column:
    """Array of the signs that a text was cut off."""
    def signs(c):
        ends = F.endswith(c, F.lit("}")) | F.endswith(c, F.lit("]"))
        return F.array_compact(F.array(
            F.when(_count(c, "{") != _count(c, "}"), F.lit("unbalanced braces")),
            F.when(_count(c, "[") != _count(c, "]"), F.lit("unbalanced brackets")),
            F.when((c != "") & ~ends, F.lit("ends abruptly")),
            F.when(F.endswith(c, F.lit('"')) & (_count(c, '"') % 2 != 0), F.lit("open string at end")),
        ))

    return bind(strip_blank(content), signs)


def repair_json(
    df: DataFrame,
    column: str = "content",
    mode: str = "fixed",
    repairs: Sequence[tuple[str, Fix]] = tuple(REPAIRS),
) -> DataFrame:
    """Add ``status, strategy, data, error_type, indicators, raw_content``.

    A text that parses is ``ok``. Otherwise it may be cut off (``likely_truncation``), or
    the first repair that changes it into JSON wins (``repaired``), or nothing helps
    (``json_parse_error``). ``mode="strict"`` looks for truncation in the raw text, so
    fenced answers count as cut off; ``mode="fixed"`` strips a fence first.
    """
    if mode not in ("fixed", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    keep_last_duplicate_key(df.sparkSession)
    out = df.withColumn("__r", _parse_or_repair(F.col(column), mode, list(repairs)))
    status = F.col("__r.status")
    failed = status.isin("likely_truncation", "json_parse_error")
    return out.select(
        *df.columns,
        status.alias("status"),
        F.col("__r.strategy").alias("strategy"),
        F.col("__r.data").alias("data"),
        F.when(failed, status).alias("error_type"),
        F.col("__r.indicators").alias("indicators"),
        F.when(failed, preview(F.col(column), RAW_PREVIEW)).alias("raw_content"),
        failed.alias("extraction_failed"),
    )


def _parse_or_repair(raw: Column, mode: str, repairs: list[tuple[str, Fix]]) -> Column:
    """struct(status, strategy, data, indicators) as one expression.

    Each intermediate text is bound once, so the expression grows linearly with the number
    of repairs and stays small where the optimizer copies it, as into a pushed-down filter.
    A repair is evaluated only when nothing before it worked.
    """
    no_text, no_data, no_signs = (F.lit(None).cast(t) for t in ("string", "variant", "array<string>"))

    def result(status, strategy=no_text, data=no_data, signs=no_signs):
        return F.struct(
            F.lit(status).alias("status"), strategy.alias("strategy"), data.alias("data"), signs.alias("indicators")
        )

    def attempt(k: int) -> Column:
        if k == len(repairs):
            return result("json_parse_error")
        name, fix = repairs[k]

        def judged(text):
            parsed = F.when((text != raw) & (text != ""), strict_variant(text))
            return bind(parsed, lambda d: F.when(
                d.isNotNull(), result("repaired", F.lit(name), d)
            ).otherwise(attempt(k + 1)))

        return bind(fix(raw), judged)

    def broken():
        looked_at = raw if mode == "strict" else strip_fence(raw)
        return bind(truncation_signs(looked_at), lambda s: F.when(
            F.size(s) > 0, result("likely_truncation", signs=s)
        ).otherwise(attempt(0)))

    return bind(strict_variant(raw), lambda d: F.when(d.isNotNull(), result("ok", data=d)).otherwise(broken()))


def _cut_after_balance(c: Column, open_: str, close: str) -> Column:
    """Text up to where the bracket opened first is closed; unchanged if it never is."""
    pieces = F.regexp_extract_all(c, F.lit(rf"[\{open_}\{close}][^\{open_}\{close}]*"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc, p):
        depth = acc["depth"] + F.when(F.startswith(p, F.lit(open_)), 1).otherwise(-1)
        closed = (acc["end"] == 0) & (depth == 0)
        return F.struct(
            depth.alias("depth"), (acc["at"] + F.length(p)).alias("at"),
            F.when(closed, acc["at"] + 1).otherwise(acc["end"]).alias("end"),
        )

    end = F.aggregate(pieces, start, step)["end"]
    return F.when(end > 0, F.left(c, end)).otherwise(c)


def clean_response(c: Column) -> Column:
    """The second cleaner: fence, outermost span, syntax fixes, and nothing after the balanced end."""
    def span(bare):
        as_object = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
        return bind(as_object, lambda o: F.when(o != "", o).otherwise(outermost(bare, "[", "]")))

    def cut(fixed):
        return (
            F.when(F.startswith(fixed, F.lit("{")), _cut_after_balance(fixed, "{", "}"))
            .when(F.startswith(fixed, F.lit("[")), _cut_after_balance(fixed, "[", "]"))
            .otherwise(fixed)
        )

    bare = strip_fence(F.regexp_replace(strip_blank(c), "^```json", ""))
    return bind(fix_syntax(bind(bare, span)), cut)


# The second cleaner's own list of repairs: any that yields JSON wins, changed or not.
RESPONSE_REPAIRS: list[tuple[str, Fix]] = [
    ("cleaned", clean_response),
    ("unfenced", lambda c: strip_blank(F.replace(F.replace(strip_blank(c), F.lit(FENCE + "json"), F.lit("")), F.lit(FENCE), F.lit("")))),
    ("object", lambda c: outermost(c, "{", "}")),
    ("array", lambda c: outermost(c, "[", "]")),
]


def classify_response(df: DataFrame, column: str = "content", mode: str = "fixed") -> DataFrame:
    """Class of each model response, with its data or the reason it failed.

    A row whose ``api_error`` is set never got a response; ``finish_reason = 'length'``
    means the model ran out of tokens, whatever the text looks like.
    """
    called = df if "api_error" in df.columns else df.withColumn("api_error", F.lit(None).cast("string"))
    parsed = repair_json(called, column, mode, RESPONSE_REPAIRS)
    cut = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    status = (
        F.when(F.col("api_error").isNotNull(), F.lit("api_error"))
        .when(cut, F.lit("token_limit_exceeded"))
        .otherwise(F.col("status"))
    )
    usable = status.isin("ok", "repaired")
    return parsed.select(
        *df.columns,
        status.alias("status"),
        F.when(status == "repaired", F.col("strategy")).alias("strategy"),
        F.when(usable, F.col("data")).alias("data"),
        F.when(~usable, status).alias("error_type"),
        F.when(status == "likely_truncation", F.col("indicators")).alias("indicators"),
        F.when(~usable, preview(F.col(column), RAW_PREVIEW)).alias("raw_content"),
        F.length(column).alias("response_length"),
        (_count(F.col(column), "{") == _count(F.col(column), "}")).alias("brackets_balanced"),
    )


def response_quality(classified: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Responses and share of each class and strategy per group."""
    counts = classified.groupBy(*by, "status", F.coalesce("strategy", F.lit("")).alias("strategy")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    return counts.join(totals, list(by)).select(
        *by, "status", "strategy", "n", F.round(F.col("n") / F.col("__total"), 6).alias("share")
    )
