"""Quotation linking for chat and mail: nested quotes lead replies to the messages they answer.

A line's quote level is the number of its leading ``>`` marks. Maximal runs of non-blank lines of one level are passages;
each is normalised (white space, case) and hashed, as a whole, by line and by sentence. What stands at level 0 a message says itself; per
conversation and hash the earliest message that says it is its original, found by a partial aggregation, so a passage that
everybody repeats is one row. Quoted passages join those originals: as a whole if they can, else by the lines they hold, else by
sentences, with the original that shares most characters. A message answers the original of its
shallowest linked quotes, by most characters. Roots and depths follow by pointer jumping over (message, parent)
rows, in as many rounds as the logarithm of the longest chain; a conversation of any size is spread over tasks.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.functions.skew import row_numbers
from paperloom.llm.store import forget, written

MARKS = "^(?:[ \\\\t]*>)+"
#: Fixed: ends of the line that mail programs put above a quote.
ATTRIBUTION = "(wrote|schrieb|escribió|écrit) ?:$"
#: Messages of one depth that share a window task: a span of the order column.
SPAN = 10_000


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with ``__passages`` (array of level, chars, hash and units, which are kind, chars and hash: 2 the passage, 1 a line,
    0 a sentence) and ``reply``, the text without quotes.

    Null counts as empty: no passages, reply ``""``. Attribution lines right above a quote go with it.
    """
    df = messages.withColumn("__lines", F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r", ""), "\n"))
    df = df.withColumn("__level", F.expr(
        f"transform(__lines, x -> length(regexp_replace(regexp_extract(x, '{MARKS}', 0), '[^>]', '')))"))
    df = df.withColumn("__body", F.expr(
        f"transform(__lines, x -> lower(trim(regexp_replace(regexp_replace(x, '{MARKS}', ''), '[ \\\\t]+', ' '))))"))
    df = df.withColumn("__level", F.expr(f"""transform(__level, (x, i) -> CASE WHEN x = 0 AND get(__level, i + 1) > 0
        AND __body[i] rlike '{ATTRIBUTION}' THEN -1 ELSE x END)"""))
    df = df.withColumn("__starts", F.expr("""filter(sequence(0, size(__lines) - 1), i -> __body[i] != '' AND __level[i] >= 0
        AND (i = 0 OR __body[i - 1] = '' OR __level[i - 1] != __level[i]))"""))
    df = df.withColumn("__passages", F.expr("""transform(__starts, (s, k) -> struct(__level[s] AS level, filter(
        slice(__body, s + 1, coalesce(get(__starts, k + 1), size(__lines)) - s), (x, i) -> x != '' AND __level[s + i] = __level[s]) AS lines))"""))
    unit = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.length(text).alias("chars"), F.md5(text).alias("hash"))

    def hashed(p):
        whole = F.array_join(p.lines, " ")
        sentences = F.filter(F.flatten(F.transform(p.lines, lambda x: F.split(x, "(?<=[.!?]) +"))), lambda x: x != "")
        units = F.concat(F.array(unit(2, whole)), F.transform(p.lines, lambda x: unit(1, x)), F.transform(sentences, lambda x: unit(0, x)))
        return F.struct(p.level.alias("level"), F.length(whole).alias("chars"), F.md5(whole).alias("hash"), units.alias("units"))

    reply = F.expr("array_join(filter(__lines, (x, i) -> __level[i] = 0), '\\n')")
    return df.select(
        *messages.columns,
        F.transform("__passages", hashed).alias("__passages"),
        F.regexp_replace(F.regexp_replace(reply, "^\\s+", ""), "\\s+$", "").alias("reply"),
    )


def link_quotes(
    messages: DataFrame, conv_col: str | None = "conv_id", order_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """``__row`` (the message), ``reply, parent, root, depth, position, n_quotes, n_linked``: one row per message.

    ``parent`` and ``root`` are values of ``order_col``; a message without a linked quote is its own root at depth 0
    with a null parent. ``position`` numbers the messages of a root by depth, then order: every message comes after the
    one it answers. A quote whose original is not earlier in the conversation links nothing. Without ``conv_col`` originals are
    looked for among all messages, and ``root`` tells the conversations that the links build. Null conversations are one
    conversation; a null order sorts first. Repeated rows are messages of their own, in a fixed but arbitrary order.
    """
    rows = messages.select(
        F.struct(*messages.columns).alias("__row"),
        F.lit("n").alias("conv") if conv_col is None else F.coalesce(F.concat(F.lit("v"), F.col(conv_col).cast("string")), F.lit("n")).alias("conv"),
        F.col(order_col).cast("long").alias("at"),
        F.col(text_col).alias("text"),
    )
    parsed = parse(rows).drop("text").withColumn("id", F.monotonically_increasing_id())
    table = written(parsed, "quotes")
    spoken = table.select("id", "conv", "at", F.posexplode("__passages").alias("passage", "p")).select("id", "conv", "at", "passage", "p.level", "p.chars", "p.units")
    units = spoken.select("id", "conv", "at", "passage", "level", F.explode("units").alias("u")).select("id", "conv", "at", "passage", "level", "u.*")
    when = F.struct("at", "id")
    originals = units.where("level = 0").groupBy("conv", "kind", "hash").agg(F.min(when).alias("original"))
    met = units.where("level > 0").join(originals, ["conv", "kind", "hash"]).where(F.col("original") < when)
    shared = met.groupBy("id", "passage", "kind", "original").agg(F.sum("chars").alias("chars"))
    # whole passages first, then lines, then sentences; the original that shares most, the earliest among equals
    rank = F.struct("kind", "chars", (-F.col("original.at")).alias("early"), (-F.col("original.id")).alias("first"))
    best = shared.groupBy("id", "passage").agg(F.max_by("original", rank).alias("original"))
    quoted = spoken.where("level > 0").drop("units").join(best, ["id", "passage"], "left")
    by_original = quoted.groupBy("id", "level", "original").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    linked = F.col("original").isNotNull()
    parents = by_original.groupBy("id").agg(
        F.max_by("original", F.when(linked, F.struct(-F.col("level"), "chars", "original"))).alias("parent"),
        F.sum("n").alias("n_quotes"),
        F.sum(F.when(linked, F.col("n")).otherwise(0)).alias("n_linked"),
    )
    links = written(table.select("id", "at", "conv").join(parents, "id", "left"), "quotes-links")
    tree = _roots(links)
    numbered = row_numbers(
        tree, ["root_id"], ["depth", "at", "id"],
        F.struct("depth", F.floor(F.col("at") / SPAN).alias("span")), "position",
    )
    return table.select("id", "__row", "reply").join(numbered, "id").join(
        links.select("id", F.col("parent.at").alias("parent"), "n_quotes", "n_linked"), "id"
    ).select(
        "__row", "reply", "parent", "root", "depth", "position",
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )


def _roots(links: DataFrame) -> DataFrame:
    """``id, at, root_id, root, depth`` from ``id, at, parent``: each round doubles the way up that is known."""
    up = F.coalesce("parent", F.struct("at", "id"))
    state = written(
        links.select("id", "at", up.alias("up"), F.col("parent").isNotNull().cast("int").alias("depth"),
                     F.col("parent").isNull().alias("done")), "quotes-tree")
    while not state.where("NOT done").isEmpty():
        above = state.select(F.col("id").alias("up_id"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        # a message whose upper end did not move stands below a root
        moved = state.where("NOT done").withColumn("up_id", F.col("up.id")).join(above, "up_id").select(
            "id", "at", F.col("higher").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") == 0).alias("done"))
        newer = written(state.where("done").unionByName(moved), "quotes-tree")
        forget(state)
        state = newer
    return state.select("id", "at", F.col("up.id").alias("root_id"), F.col("up.at").alias("root"), "depth")
