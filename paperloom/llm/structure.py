"""Conversation structure repair with Four-Russians block tables.

A conversation should read ``(s?(ua)+)?`` in its roles' initials. Rows are kept, given another role, deleted, or empty rows are
inserted, at least cost; of equally cheap repairs the one with the least edit letters stands. The costs to finish
from each of the four states of that pattern, read from the end, are a vector that one row turns into the next. Less
their minimum there are few such vectors, so a table holds for every vector and every block of ``BLOCK`` row symbols
the vector in front of it and the cost added. Conversations are read block by block through the table, last block
first; then the blocks are expanded in the opposite order, each from the vector behind it, and edits are taken
from the front, the least letter that still reaches the least cost.

A conversation of any length is spread: rows are sorted over all tasks by conversation and turn and cut into pieces of at most
``PIECE`` rows. What a piece does to a vector is a 4 x 4 matrix, from the same tables; only these and the states at the
cuts pass from piece to piece, one summary row per piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.store import forget, written
from paperloom.llm.words import SPACES, word_chars

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows per lookup, and rows of a conversation per piece.
BLOCK = 4
PIECE = 1 << 16
#: States: nothing yet, after s, after u, after a. Where u, a or s lead from each; none is -1.
_NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
#: The only role that can be inserted in each state, and the state after it.
_WANTED, _AFTER = "uuau", (2, 2, 3, 2)
#: Row symbols: initial (s, u, a, other), four more if truncated; the last must be deleted.
_INITIALS, _GONE, _SYMBOLS = "sua", 8, 9
_NEVER = 1 << 40
#: Cost to finish behind the last row.
FINAL = (0, 2 * INSERT, INSERT, 0)
Vector = tuple[int, ...]


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` for a row, by letter."""
    out = [("D", DELETE, state)]
    if symbol != _GONE:
        more, initial = TRUNCATED * (symbol // 4), symbol % 4
        if initial < 3 and _NEXT[_INITIALS[initial]][state] >= 0:
            out.append(("K", KEEP + more, _NEXT[_INITIALS[initial]][state]))
        out.append(("R", REROLE + more, _AFTER[state]))
    return out


def _before(symbol: int, behind: Vector) -> Vector:
    """Costs to finish in front of a row, from those behind it."""
    costs = [min(_NEVER, *(c + behind[q] for _, c, q in _moves(symbol, state))) for state in range(4)]
    for _ in range(3):  # two rows are inserted in a line at most
        costs = [min(costs[q], INSERT + costs[_AFTER[q]]) for q in range(4)]
    return tuple(min(c, _NEVER) for c in costs)


def _normal(costs: Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(_NEVER if c >= _NEVER else c - least for c in costs), least


class Tables:
    """Vectors that can occur, and where each row symbol and each block of ``BLOCK`` symbols leads from them."""

    def __init__(self, block: int = BLOCK):
        units = [tuple(0 if p == q else _NEVER for p in range(4)) for q in range(4)]
        self.block, self.vectors, self.number, step = block, [], {}, []
        for v in (FINAL, *units):
            self._known(v)
        while len(step) < len(self.vectors):
            row = []
            for symbol in range(_SYMBOLS):
                vector, cost = _normal(_before(symbol, self.vectors[len(step)]))
                row.append((self._known(vector), cost))
            step.append(row)
        self.one = np.array(step)  # vector, symbol -> (vector, cost)
        self.many = self.one
        for _ in range(block - 1):  # one more symbol in front: its number is the lowest digit
            to, cost = self.many[..., 0], self.many[..., 1]
            self.many = np.stack([self.one[to, :, 0], self.one[to, :, 1] + cost[..., None]], -1).reshape(len(step), -1, 2)

    def _known(self, vector: Vector) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    def boundaries(self, symbols: list[int], behind: Vector) -> list[tuple[int, int]]:
        """``(vector, cost)`` at the end and before each block, last block first; the front block may be short."""
        vector, cost = _normal(behind)
        at, out, end = self._number_of(vector), [], len(symbols)
        out.append((at, cost))
        while end:
            if end >= self.block:
                key = 0
                for s in reversed(symbols[end - self.block : end]):
                    key = key * _SYMBOLS + s
                at, more = self._lookup(at, key)
                cost, end = cost + more, end - self.block
            else:
                for s in reversed(symbols[:end]):
                    at, more = map(int, self.one[at, s])
                    cost += more
                end = 0
            out.append((at, cost))
        return out

    def _number_of(self, vector: Vector) -> int:
        if vector not in self.number:
            raise ValueError(f"{vector} cannot occur")
        return self.number[vector]

    def _lookup(self, at: int, key: int) -> tuple[int, int]:
        to, cost = self.many[at, key]
        return int(to), int(cost)

    def front(self, symbols: list[int], behind: Vector) -> Vector:
        at, cost = self.boundaries(symbols, behind)[-1]
        return tuple(min(_NEVER, c + cost) for c in self.vectors[at])

    def matrix(self, symbols: list[int]) -> list[int]:
        """Least cost from each state in front to each state behind, by rows."""
        columns = [self.front(symbols, tuple(0 if p == q else _NEVER for p in range(4))) for q in range(4)]
        return [columns[q][p] for p in range(4) for q in range(4)]

    def trace(self, symbols: list[int], behind: Vector, state: int, last: bool) -> tuple[list[str], list[str], int]:
        """Edit letters and new roles per row from ``state`` on, and the state behind. ``last``: finish the pattern."""
        marks, letters, roles, start = self.boundaries(symbols, behind)[::-1], [], [], 0
        for (at, _) in marks[1:]:
            size = (len(symbols) - start) % self.block or self.block
            own, new, state = _expand(self, at, tuple(symbols[start : start + size]), state)
            letters += own
            roles += new
            start += size
        while last and FINAL[state]:
            letters[-1] += "I"
            roles[-1] += _WANTED[state]
            state = _AFTER[state]
        return letters, roles, state


@lru_cache(1)
def tables() -> Tables:
    return Tables()


@lru_cache(1 << 16)
def _expand(known: Tables, at: int, symbols: tuple[int, ...], state: int) -> tuple[list[str], list[str], int]:
    """One block in full: costs from the vector behind it to its front, edits from its front, least letter first."""
    costs = [known.vectors[at]]
    for s in reversed(symbols):
        costs.append(_before(s, costs[-1]))
    letters, roles = [], []
    for s, here, behind in zip(symbols, costs[:0:-1], costs[-2::-1]):
        own, new = "", ""
        while True:
            fits = {letter: q for letter, c, q in _moves(s, state) if c + behind[q] == here[state]}
            if "D" not in fits and INSERT + here[_AFTER[state]] == here[state]:
                own, new, state = own + "I", new + _WANTED[state], _AFTER[state]
                continue
            letter = min(fits)
            own, new, state = own + letter, new + (_WANTED[state] if letter == "R" else "-"), fits[letter]
            break
        letters.append(own)
        roles.append(new)
    return letters, roles, state


def fault(text: Column, repeated: Column) -> Column:
    """A row's first fault: blank, duplicate, truncated or none."""
    ends = F.substring(F.rtrim(text, F.lit(" " + SPACES)), -1, 1).isin(".", "!", "?")
    return F.when(word_chars(text) == 0, "blank").when(repeated, "duplicate").when(~ends, "truncated")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(summary, repaired)`` of conversations.

    ``summary``: one row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.
    ``repaired``: ``conv_id, at, step, edit, role, text``, one row per row that stays, ordered by ``at, step``; deleted
    rows are those of ``summary``'s D and not in it.

    Rows are taken by turn, null turns first; rows of one turn by the MD5 of role and text. A null role or text counts as one
    space, null conversation ids are one conversation. Repeated rows are duplicates of the first. An empty table gives two
    empty results; other columns are not read and may have any names. ``audit`` is one cell, with a letter per edit.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("v"), F.col(conv_col).cast("string")), F.lit("n"))
    taken = written(
        rows.select(F.col(conv_col).alias("conv"), key.alias("k"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
        .withColumns({"same": F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))), "row": F.monotonically_increasing_id()}), "turns")
    first = F.min(F.struct(F.col("turn").isNotNull(), "turn", "row")).alias("first")
    shared = taken.groupBy("k", "same").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = taken.join(shared.select("k", "same", "first"), ["k", "same"], "left")
    order = [F.col("k"), F.col("turn").asc_nulls_first(), F.col("same"), F.col("row")]
    initial = F.coalesce(F.nullif(F.position(F.substring("role", 1, 1), F.lit(_INITIALS)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 8).when(F.col("fault").isNotNull(), 4).otherwise(0)
    ordered = written(
        marked.withColumn("fault", fault(F.col("text"), F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))))
        .select("conv", "k", "turn", "role", "text", "fault", "same", "row", (initial + kind).cast("int").alias("code"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .drop("same", "row").withColumn("at", F.monotonically_increasing_id()), "turns-ordered")
    forget(taken)
    in_file = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    pieces = written(
        ordered.groupBy("k", F.shiftright("at", 33).alias("part"), F.floor(in_file / PIECE).alias("piece"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("r"))  # PIECE rows at most
        .select("k", F.col("r")[0]["at"].alias("start"), F.col("r")["at"].alias("ats"), F.col("r")["code"].alias("codes")), "turns-pieces")
    plan = _plan(pieces)
    traced = written(
        pieces.join(plan, ["k", "start"], "left")
        .select("k", "start", "ats", "codes", F.coalesce("state", F.lit(0)).alias("state"),
                F.coalesce("behind", F.array(*map(F.lit, FINAL)).cast("array<long>")).alias("behind"), F.coalesce("last", F.lit(True)).alias("last"))
        .mapInArrow(_traced, "k string, start long, ats array<long>, letters array<string>, roles array<string>, cost long, illegal long, first int, final int"),
        "turns-traced")
    return _summary(ordered, traced), _repaired(ordered, traced)


def _plan(pieces: DataFrame) -> DataFrame:
    """``k, start, state, behind, last`` of the pieces of conversations that have several: the state each begins in, and
    the costs to finish behind it. One row per piece passes through a conversation's group."""
    several = pieces.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    cut = written(pieces.join(several, "k").select("k", "start", "codes"), "turns-cut")
    matrices = cut.mapInArrow(_per_piece(lambda codes, _: tables().matrix(codes)), "k string, start long, values array<long>")
    behind = written(_chained(matrices, _backward), "turns-behind")
    exits = cut.join(behind, ["k", "start"]).mapInArrow(
        _per_piece(lambda codes, values: [tables().trace(codes, tuple(values), q, False)[2] for q in range(4)]), "k string, start long, values array<long>")
    states = _chained(exits, _forward).select("k", "start", F.col("values")[0].cast("int").alias("state"), "last")
    return states.join(behind.select("k", "start", F.col("values").alias("behind")), ["k", "start"])


def _per_piece(value: Callable) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("values") if "values" in batch.schema.names else [None] * len(batch)
            out = [value(_symbols(c.as_py()), v and v.as_py()) for c, v in zip(batch.column("codes"), given)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("start"), pa.array(out, pa.list_(pa.int64()))], names=["k", "start", "values"])

    return run


def _chained(summaries: DataFrame, scan: Callable) -> DataFrame:
    """``scan`` over a conversation's piece summaries in order."""
    chains = summaries.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "values"))).alias("chain"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, chain in zip(batch.column("k").to_pylist(), batch.column("chain")):
                chain = chain.as_py()
                out = scan([x["values"] for x in chain])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(chain), pa.string()), pa.array([x["start"] for x in chain], pa.int64()), pa.array(out, pa.list_(pa.int64())),
                     pa.array([i + 1 == len(chain) for i in range(len(chain))])], names=["k", "start", "values", "last"])

    return chains.mapInArrow(run, "k string, start long, values array<long>, last boolean")


def _backward(matrices: list[list[int]]) -> list[Vector]:
    """Costs behind each piece, less their minimum."""
    out, costs = [], FINAL
    for m in reversed(matrices):
        costs = _normal(costs)[0]
        out.append(costs)
        costs = tuple(min(_NEVER, *(m[4 * p + q] + costs[q] for q in range(4))) for p in range(4))
    return out[::-1]


def _forward(exits: list[list[int]]) -> list[list[int]]:
    out, state = [], 0
    for to in exits:
        out.append([state])
        state = to[state]
    return out


def _symbols(codes: list[int]) -> list[int]:
    return [min(c, _GONE) for c in codes]


def _traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {c: [] for c in ("letters", "roles", "cost", "illegal", "first", "final")}
        for codes, behind, state, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "behind", "state", "last"))):
            symbols, known = _symbols(codes), tables()
            letters, roles, to = known.trace(symbols, tuple(behind), state, last)
            initials = np.array(codes) % 4
            legal = (initials[:-1] < 2) & (initials[1:] == initials[:-1] + 1) | (initials[:-1] == 2) & (initials[1:] == 1)
            rows["letters"].append(letters)
            rows["roles"].append(roles)
            rows["cost"].append(known.front(symbols, tuple(behind))[state] - (0 if last else behind[to]))
            rows["illegal"].append(int((~legal).sum()))
            rows["first"].append(int(initials[0]))
            rows["final"].append(int(initials[-1]))
        kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("start"), batch.column("ats"), *(pa.array(v, kind) for v, kind in zip(rows.values(), kinds))],
            names=["k", "start", "ats", *rows])


def _summary(ordered: DataFrame, traced: DataFrame) -> DataFrame:
    counts = {f: F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")}
    by_turn = ordered.groupBy("k", "turn").agg(F.any_value("conv").alias("conv"), *counts.values())
    faults = by_turn.groupBy("k").agg(
        F.any_value("conv").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(f).alias(f) for f in counts))
    chain = traced.groupBy("k").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_sort(F.collect_list(F.struct("start", F.array_join("letters", "").alias("audit"), "first", "final"))).alias("p"))
    seam = lambda a, b: F.when(((a == 0) | (a == 2)) & (b == 1) | (a == 1) & (b == 2), 0).otherwise(1)
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p")).alias("b"))
    seams = F.when(F.size("p") > 1, F.aggregate(pairs, F.lit(0), lambda n, x: n + seam(x["a"]["final"], x["b"]["first"]))).otherwise(0)
    return faults.join(chain, "k").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + seams).alias("illegal"), "cost",
        F.array_join(F.col("p")["audit"], "").alias("audit"))


def _repaired(ordered: DataFrame, traced: DataFrame) -> DataFrame:
    edits = traced.select(F.explode(F.arrays_zip("ats", "letters", "roles")).alias("e")).select(F.col("e.ats").alias("at"), "e.letters", "e.roles")
    steps = ordered.select("conv", "at", "role", "text").join(edits, "at").select(
        "conv", "at", "role", "text", "letters", "roles", F.explode(F.sequence(F.lit(1), F.length("letters"))).alias("step"))
    one = lambda c: F.substring(F.col(c), F.col("step"), F.lit(1))
    role = F.when(one("roles") == "u", "user").when(one("roles") == "a", "assistant").otherwise(F.col("role"))
    return steps.where(one("letters") != "D").select(
        F.col("conv").alias("conv_id"), "at", "step", one("letters").alias("edit"), role.alias("role"),
        F.when(one("letters") == "I", "").otherwise(F.col("text")).alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: hash of the ``role:text`` rows of a conversation, joined by newlines.

    SHA-256 takes its input in order, so a conversation passes through one task; rows stream through it and are not held.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark, row = None, None, None
        done = lambda r, m: pa.RecordBatch.from_arrays([r, pa.array([m.hexdigest()])], names=["conv_id", "repaired_sha256"])
        for batch in batches:
            for i, (k, line) in enumerate(zip(batch.column("k").to_pylist(), batch.column("line"))):
                if k != held:
                    if mark:
                        yield done(row, mark)
                    held, mark, row = k, hashlib.sha256(), batch.column("conv_id").slice(i, 1)
                else:
                    mark.update(b"\n")
                mark.update(line.as_py())
        if mark:
            yield done(row, mark)

    key = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    lines = repaired.select(key.alias("k"), "conv_id", "at", "step", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    kind = dict(repaired.dtypes)["conv_id"]
    return lines.repartition("k").sortWithinPartitions("k", "at", "step").select("k", "conv_id", "line").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
