"""Exact deduplication by content hash with a byte comparison.

Rows are grouped by the 128-bit MD5 of their normalised text. Only (hash, id) goes through that grouping, and ids are
combined before the shuffle, so a group of any size is one summary row per task. Texts are fetched only for hashes
found twice or more; each is compared, byte for byte, with the text of the row that would stay. Rows that differ from
it are a collision; they are grouped again by the text itself, so that no hash decides for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.store import forget, written
from paperloom.llm.words import lower_ascii


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", key: Column | None = None
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    ``keep`` is "min" (the smallest id stays) or "max". ``key`` replaces the MD5 of the normalised text, a column
    over ``__norm``; tests use a weak one to force collisions.

    Null and empty texts are equal. Null ids sort below all others; ``keep_id`` is null if the staying row's is. Of
    rows with the staying id exactly one is kept, so repeated rows leave one row. An empty table gives an empty
    result. Other columns of ``docs`` are not read and may have any names.
    """
    return _grouped(docs.select(F.col(id_col).alias("__id"), _norm(text_col)), keep, key).select(
        F.col("__id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Rows of ``docs`` that stay, with their own columns; the rules are those of ``exact_groups``."""
    names = docs.columns
    packed = docs.select(F.col(id_col).alias("__id"), _norm(text_col), F.struct(*names).alias("__doc"))
    return _grouped(packed, keep, None).where("kept").select("__doc.*")


def _norm(text_col: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("__norm")


def _grouped(rows: DataFrame, keep: str, key: Column | None) -> DataFrame:
    """``rows`` has __id, __norm and anything else; adds the columns of the result."""
    if keep not in ("min", "max"):
        raise ValueError(f"keep is min or max, not {keep}")
    best = F.max if keep == "max" else F.min
    order = F.struct(F.col("__id").isNotNull(), "__id", "__row")
    if keep == "min":
        order = F.struct(F.col("__id").isNull(), "__id", "__row")
    key = F.unhex(F.md5("__norm")) if key is None else key
    extra = [c for c in rows.columns if c not in ("__id", "__norm")]
    table = written(
        rows.select(
            "__id", "__norm", *extra, key.alias("__key"), F.sha2("__norm", 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "exact",
    )
    groups = table.groupBy("__key").agg(best(order).alias("__best"), F.count(F.lit(1)).alias("__n"))
    shared = groups.where("__n > 1")
    members = written(table.select("__key", "__id", "__row", "__norm").join(shared, "__key"), "exact-members")
    stays = members.where(F.col("__best.__row") == F.col("__row")).select(
        F.col("__key"), F.col("__norm").alias("__text")
    )
    compared = written(
        members.join(stays, "__key").select(
            "__row", "__id", "__key", (F.col("__norm") == F.col("__text")).alias("__same"),
            F.when(F.col("__norm") != F.col("__text"), F.col("__norm")).alias("__norm"),
        ),
        "exact-compared",
    )
    forget(members)
    alike = compared.where("__same").groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), best(order).alias("__best"))
    odd = compared.where(~F.col("__same"))
    # grouped by the text itself: whatever shares a hash without being equal
    odd_groups = odd.groupBy("__norm").agg(F.count(F.lit(1)).alias("__n"), best(order).alias("__best"))
    odd_rows = odd.join(odd_groups, "__norm").select("__row", "__n", "__best")
    same_rows = compared.where("__same").select("__row", "__key").join(alike, "__key").select("__row", "__n", "__best")
    return (
        table.drop("__norm", "__key")
        .join(same_rows.union(odd_rows), "__row", "left")
        .select(
            "__id", *extra,
            F.when(F.col("__n").isNull(), F.col("__id")).otherwise(F.col("__best.__id")).alias("keep_id"),
            F.coalesce("__n", F.lit(1)).alias("group_size"),
            F.coalesce(F.col("__best.__row") == F.col("__row"), F.lit(True)).alias("kept"),
            "text_sha256",
        )
    )
