"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's target is its weighted share of all words, bounded by ``max_epochs`` times its size; what is above the
bound goes to the other sources by weight. The bounded sources are those with the smallest size-to-weight ratios, so
the level at which the rest stands follows from prefix sums over the sources in that order, without a loop.

Within a source each document is expected ``target / size`` times. The prefix sum of these expectations, shifted by
one offset per source, crosses an integer once for each copy the mix takes. Documents are ordered by size class and
then by a hash of id and text, so every size is hit in proportion and taken words follow the target closely. A source may hold
most of the table: its order is cut into buckets of bounded expected size, ranks are counted inside a bucket and carried
over as one count per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from paperloom.functions.skew import row_numbers
from paperloom.llm.store import small, written
from paperloom.llm.words import words

#: Rows of one source and size class that share a window task, on average.
BUCKET_ROWS = 20_000
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source, null allowed.

    Sources in code point order, null last, take ``weights`` in turn. One row per source goes through one task.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    return (
        sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
        .withColumn("cap", F.col("source_size") * float(max_epochs))
        .withColumn("left", F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("w_left"))
        # the first source in ratio order that its own level does not push above its bound: it and the rest share
        .withColumn("level", F.first(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), True).over(whole))
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))
    )


def document_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = 3,
) -> DataFrame:
    """One row per input row: ``__doc`` (a struct of the id and ``carry``), ``size, source_size, target, copies``.

    A null or wordless text has size 0 and is never taken. A null source is a source of its own. Rows that agree in id
    and text are interchangeable: how many copies they get together is fixed, not which of them. A source without
    words has target 0. An empty table gives an empty result. ``carry`` names the columns to hand on, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), text))
    rows = written(
        docs.select(
            F.struct(*dict.fromkeys([id_col, *carry])).alias("__doc"),
            F.coalesce(F.concat(F.lit("v"), F.col(source_col)), F.lit("n")).alias("key"),
            F.col(source_col).alias("source"),
            F.size(words(text)).cast("long").alias("size"),
            order.alias("order"),
        ).withColumn("class", F.floor(F.sqrt("size"))),
        "mixing",
    )
    classes = written(
        rows.groupBy("key", "source", "class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mixing-classes"
    )
    targets = source_targets(
        classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs
    ).withColumn("key", F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n")))
    offset = F.conv(F.substring(F.md5("key"), 1, 5), 16, 10).cast("double") / 2.0**20
    plan = written(
        classes.select("key", "class", F.ceil(F.col("n") / BUCKET_ROWS).alias("parts")).join(
            targets.select("key", "source_size", "target", offset.alias("offset")), "key"
        ),
        "mixing-plan",
    )
    planned = rows.drop("source").join(small(plan), ["key", "class"])
    spot = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2.0**32
    bucket = F.struct("class", F.floor(spot * F.col("parts")).alias("part"))
    ranked = row_numbers(planned, ["key"], ["class", "order"], bucket, "rank")
    each = F.col("target") / F.col("source_size")
    crossed = F.floor(F.col("offset") + each * F.col("rank")) - F.floor(F.col("offset") + each * (F.col("rank") - 1))
    return ranked.select(
        "__doc", "size", "source_size", "target", F.when(F.col("size") > 0, crossed).otherwise(0).cast("long").alias("copies")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = 3,
) -> DataFrame:
    """The mix: rows of ``docs``, each as often as ``document_copies`` says."""
    copies = document_copies(docs, id_col, text_col, source_col, docs.columns, weights, max_epochs).where("copies > 0")
    repeated = copies.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__nth"))
    return repeated.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])
