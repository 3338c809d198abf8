"""SimHash near copies: a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Two that differ in at most three bits differ in at most three bytes, so they share at least
``MATCHES`` = 5 bytes at their positions. The index lists fingerprints under the bytes they hold at a few positions:
whatever two of them share, the positions of one entry of ``families`` lie inside it, so they meet in a list. For each
pair of a list the shared positional bytes are tallied; pairs that reach the guaranteed five are verified by their bits.

* Entries of one byte hold 1/256 of all fingerprints, so an entry takes as many bytes as the number of distinct
  fingerprints asks for (``entry_bytes``); the guarantee is the same for each width.
* Documents with equal fingerprints are one entry. Pairs are never rows: a task compares the fingerprints of its lists
  and returns the spanning forest of the verified pairs.
* A list above ``LIST`` is not compared. Its fingerprints are indexed again under more bytes, up to five; what is longer
  still is solved without comparing pairs: two fingerprints within three bits have a value within one bit of the
  one and two of the other. Grouped by such values, everything linked meets, and the cost stays linear.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.graph import components
from paperloom.llm.store import forget, small, written

SHINGLE = 3
SEED = 42
BITS = 3
MATCHES = 8 - BITS
#: Fingerprints in a list up to which its pairs are compared.
LIST = 512
#: Comparisons that cost as much as one entry of the index, which is written, counted and shuffled.
PAIRS_PER_ENTRY = 16
#: Hashes summed at a time, and rows returned at a time.
CHUNK = 1 << 16
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id``.

    ``fingerprint`` has 16 hexadecimal digits; ``component_id`` is the smallest id reachable by links of at most three
    differing bits. Texts without words, null or empty ones among them, have fingerprint zero and are linked like others.
    Null ids get a component but never name one, unless it has no other id. Repeated rows are returned as often as they
    come. An empty table gives an empty result; other columns are not read and may have any names.
    """
    marks = written(fingerprints(docs, id_col, text_col), "simhash")
    firsts = written(marks.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    links = written(near_links(firsts.select("fp")), "simhash-links")
    reached = components(links)
    named = reached.join(firsts, reached["node"] == firsts["fp"]).select("fp", "label", "first")
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    joined = named.join(least, "label").select("fp", "least")
    of = written(firsts.join(joined, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-components")
    forget(links)
    return marks.join(of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint of each whole text as a long of the same 64 bits."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([simhash(t.as_py() or b"") for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks.view(np.int64))], names=["id", "fp"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(mark, f"id {kind}, fp long")


def simhash(text: bytes, width: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's word shingles, A-Z lower-cased; no words, no bits."""
    words = text.lower().split()  # of bytes: the six ASCII spaces part words, and only A-Z change
    if not words:
        return 0
    ends = list(accumulate(len(w) + 1 for w in words))
    line = b" ".join(words)
    starts = [0, *ends[:-1]]
    lasts = ends[width - 1 :] or ends[-1:]
    set_bits, digest = np.zeros((8, 8), np.int64), xxhash.xxh64_digest
    for at in range(0, len(lasts), CHUNK):
        spans = zip(starts[at : at + CHUNK], lasts[at : at + CHUNK])
        hashes = np.frombuffer(b"".join([digest(line[s : e - 1], SEED) for s, e in spans]), np.uint8).reshape(-1, 8)
        set_bits += np.bincount((hashes + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BIT
    return int.from_bytes(np.packbits(2 * set_bits.ravel() > len(lasts)).tobytes(), "big")


@lru_cache
def families(width: int) -> tuple[tuple[int, ...], ...]:
    """Sets of ``width`` byte positions such that any ``MATCHES`` of the eight contain one of them, chosen greedily."""
    open_, chosen = set(combinations(range(8), MATCHES)), []
    while open_:
        best = max(combinations(range(8), width), key=lambda c: sum(set(c) <= set(o) for o in open_))
        chosen.append(best)
        open_ = {o for o in open_ if not set(best) <= set(o)}
    return tuple(chosen)


def entry_bytes(n: int) -> int:
    """The number of positions in an entry for which entries and expected comparisons of ``n`` fingerprints cost least."""
    return min(range(1, MATCHES + 1), key=lambda w: len(families(w)) * (1 + n / 256**w / 2 / PAIRS_PER_ENTRY))


def near_links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links that connect whatever distinct fingerprints (``fp``) can reach by at most ``BITS`` differing bits."""
    left, width, found = distinct, entry_bytes(distinct.count()), []
    while True:
        index = written(left.mapInArrow(_entries(width), "entry long, positions int, fp long"), "simhash-index")
        counts = index.groupBy("entry", "positions").count()
        long_lists = written(counts.where(F.col("count") > LIST).select("entry", "positions"), "simhash-long")
        if long_lists.isEmpty():
            return _union([*found, _compared(index)])
        hot = small(long_lists)
        found.append(written(_compared(index.join(hot, ["entry", "positions"], "left_anti")), "simhash-found"))
        rest = index.join(hot, ["entry", "positions"])
        if width == MATCHES:
            return _union([*found, _ball_links(rest)])
        left, width = written(rest.select("fp").distinct(), "simhash-rest"), width + 1
        forget(index)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _masks(width: int) -> list[np.uint64]:
    return [np.uint64(sum(255 << 8 * p for p in ps)) for ps in families(width)]


def _entries(width: int):
    """A fingerprint's entries: the number of the positions' set, and the bytes there with zeros elsewhere."""
    masks = _masks(width)

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for i, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((fp & mask).view(np.int64)), pa.array(np.full(len(fp), i, np.int32)), batch.column("fp")],
                    names=["entry", "positions", "fp"])

    return entries


def _compared(index: DataFrame) -> DataFrame:
    lists = index.repartition("entry", "positions").sortWithinPartitions("positions", "entry", "fp")
    return lists.mapInArrow(_pairs, "a long, b long")


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists come one after the other; the last of a batch waits for its end."""
    kept = None
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("positions", "entry", "fp")]
        if kept is not None:
            rows = [np.concatenate(x) for x in zip(kept, rows)]
        new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        cut = int(new[-1]) + 1 if len(new) else 0
        yield from _forest(*_verified(*(r[:cut] for r in rows)))
        kept = [r[cut:] for r in rows]
    if kept is not None:
        yield from _forest(*_verified(*kept))


def _verified(positions: np.ndarray, entry: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal entries that share enough positional bytes and differ in few enough bits; rows lie list by list."""
    fp, at, step, a, b = fp.view(np.uint64), np.arange(len(fp)), 0, [], []
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        at = at[(entry[at] == entry[at + step]) & (positions[at] == positions[at + step])]
        apart = fp[at] ^ fp[at + step]
        shared = np.count_nonzero(apart.view(np.uint8).reshape(-1, 8) == 0, axis=1)
        enough = np.flatnonzero(shared >= MATCHES)
        near = at[enough[np.bitwise_count(apart[enough]) <= BITS]]
        a.append(fp[near])
        b.append(fp[near + step])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _forest(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of every fingerprint to the smallest (as a long) that these pairs connect it with."""
    if not len(a):
        return
    nodes, at = np.unique(np.concatenate([a, b]).view(np.int64), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["a", "b"])


def _ball_links(rest: DataFrame) -> DataFrame:
    """Links inside lists of five shared bytes, whatever their length: all that lie within two bits of a value are linked
    with one that lies within one bit of it. A value has 2081 such neighbours at most, so no group is large."""
    flips = []
    for ps in families(MATCHES):
        free = [np.uint64(1 << (8 * p + i)) for p in range(8) if p not in ps for i in range(8)]
        flips.append(np.array([0, *free, *(x | y for x, y in combinations(free, 2))], np.uint64))

    def balls(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, fp in zip(batch.column("positions").to_pylist(), batch.column("fp").to_numpy().view(np.uint64)):
                values = fp ^ flips[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(np.full(len(values), fp).view(np.int64)),
                     pa.array(np.arange(len(values)) <= 8 * BITS)], names=["value", "fp", "near"])

    values = rest.select("positions", "fp").mapInArrow(balls, "value long, fp long, near boolean")
    groups = values.groupBy("value").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"), F.collect_set("fp").alias("all"))
    return groups.where("b IS NOT NULL AND size(all) > 1").select(F.explode("all").alias("a"), "b").where("a <> b").distinct()
