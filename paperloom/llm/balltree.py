"""Ranked lexical search as an exact maximum inner-product search over ball trees of sparse vectors.

A document is the vector of its terms' length-normalised frequencies, an item the vector of its terms' weights times their
occurrences; both hold integers, and the score is their inner product. Tasks put their documents into blocks and build a
ball tree over each: a node has the centroid of its documents, the radius around it, and the furthest that any of them
lies beyond the centroid in each coordinate. No document below a node scores more than

    item . centroid + min(|item| * radius, item . furthest)

which is computed in floating point and rounded up by more than its error can be. Nodes are opened best-first; a subtree
whose bound is below the k-th best score so far is left out, one whose bound is equal is not, so ties stay. At leaves
scores are summed in 64-bit integers.

* Only coordinates that an item asks for can add to a score, so vectors are cut to the items' terms. Document counts and
  lengths come from the whole texts of all documents.
* A first search over some thousand documents gives every item a floor: the best k of all documents are at least as good
  as the best k of a few. It prunes; which documents it reads does not change the result.
* Items come in blocks of bounded size; only a block's terms and weights reach the driver and the tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from paperloom.llm.store import forget, small, written

#: Terms of items in one block of items, each counted once per item.
BLOCK_TERMS = 1 << 14
#: Documents in one tree at most; fewer where their dense block would pass ``DENSE_BYTES``.
TREE_ROWS = 2048
DENSE_BYTES = 64 << 20
LEAF_ROWS = 32
#: Items whose bounds are computed at a time.
ITEMS = 128
#: Documents, about, that give the floors.
FLOOR_ROWS = 8192
#: Relative error of a sum of products of numbers above zero is below terms * 2**-52; this is over a thousand times that.
SLACK = 1e-9
#: Bytes inside terms, A-Z as a-z; all others part them.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


@dataclass
class Items:
    """A block of items: ``columns[i]`` are item i's coordinates and ``weights[i]`` its entries there."""

    rows: list[int]
    columns: list[np.ndarray]
    weights: list[np.ndarray]
    n_terms: int


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """``item_col, rank, id_col, score``: each item's ``k`` best documents with a score above 0, ranked from 1.

    Equal scores go by ascending document id, null ids last. Repeated items are ranked each on its own, repeated
    documents too. Null and empty texts have no terms: such items return nothing, such documents are in no result. Empty tables give
    an empty result. Other columns of both tables are not read and may have any names.
    """
    numbered = written(items.select(
        F.col(item_col).alias("item"), F.col(query_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row")), "search-items")
    asked = written(numbered.select("row", "text").mapInArrow(_item_terms, "row long, term binary, n long"), "search-terms")
    blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).collect()  # bounded by BLOCK_TERMS
        part = _search_block(texts, [(r["row"], bytes(r["term"]), r["n"]) for r in rows], k)
        found = part if found is None else found.unionByName(part)
    named = found.join(small(numbered.select("row", "item")), "row")
    return named.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
            counts = Counter(terms(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                names=["row", "term", "n"])


def _search_block(texts: DataFrame, asked: list[tuple[int, bytes, int]], k: int) -> DataFrame:
    words = sorted({t for _, t, _ in asked})
    place = {t: i for i, t in enumerate(words)}
    kind = dict(texts.dtypes)["id"]
    vectors = written(texts.mapInArrow(_vectors(place), f"id {kind}, n long, terms array<int>, counts array<int>"), "search-vectors")
    size, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(words), np.int64)
    for r in vectors.select("terms").mapInArrow(_holders(len(words)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        holding[r["term"]] = r["n"]
    weight = [math.floor(1000 * math.log((2 * size + 2) / (2 * int(df) + 1))) for df in holding]
    of: dict[int, tuple[list[int], list[int]]] = {}
    for row, term, n in asked:
        at, entry = place[term], n * weight[place[term]]
        if entry > 0 and holding[at]:
            of.setdefault(row, ([], []))
            of[row][0].append(at)
            of[row][1].append(entry)
    block = Items(list(of), [np.array(c, np.int64) for c, _ in of.values()], [np.array(w, np.int64) for _, w in of.values()], len(words))

    def best(table: DataFrame, floors: np.ndarray) -> DataFrame:
        tops = table.mapInArrow(_searched(block, floors, k, size, length), f"row long, id {kind}, score long")
        order = W.partitionBy("row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(max(1, size // FLOOR_ROWS))) == 0)
    lowest = {r["row"]: r["score"] for r in best(some, np.ones(len(of), np.int64)).where(F.col("rank") == k).select("row", "score").collect()}
    found = written(best(vectors, np.array([max(1, lowest.get(r, 1)) for r in block.rows], np.int64)), "search-found")
    forget(vectors)
    return found


def _vectors(place: dict[bytes, int]) -> Callable:
    """Per document its number of terms, and places and occurrences of those that the items ask for."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part, sizes, held, times = batch.slice(at, 1024), [], [], []
                for text in part.column("text"):
                    own = terms(text.as_py())
                    counts = Counter(own)
                    both = counts.keys() & place.keys()
                    sizes.append(len(own))
                    held.append([place[t] for t in both])
                    times.append([counts[t] for t in both])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                    names=["id", "n", "terms", "counts"])

    return cut


def _holders(n_terms: int) -> Callable:
    """Documents per term, summed within the task."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    return count


def _searched(items: Items, floors: np.ndarray, k: int, size: int, length: int) -> Callable:
    """The best ``k`` of each tree for each item, from documents' vectors."""
    rows = max(LEAF_ROWS, min(TREE_ROWS, DENSE_BYTES // 8 // max(1, items.n_terms)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, len(batch), rows):
                waiting.append(batch.slice(at, rows))
                if sum(map(len, waiting)) >= rows:
                    table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                    yield one(table.slice(0, rows))
                    waiting = [table.slice(rows)]
        if sum(map(len, waiting)):
            yield one(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = batch.column("terms").value_lengths().to_numpy()
        columns, at = np.unique(batch.column("terms").flatten().to_numpy(), return_inverse=True)
        of = np.repeat(np.arange(len(batch)), lengths)
        tf = batch.column("counts").flatten().to_numpy().astype(np.int64)
        norm = np.array([75 + 25 * n * size // length for n in batch.column("n").to_pylist()] if length else [], np.int64)
        dense = np.zeros((len(batch), len(columns)))
        dense[of, at] = 10**9 * tf // (1000 * tf + 12 * norm[of])  # below 2**53, so exact
        by_id = np.empty(len(batch), np.int64)
        by_id[pc.sort_indices(batch.column("id"), null_placement="at_end").to_numpy()] = np.arange(len(batch))
        hits = Tree(dense).best(items, columns, floors, k, by_id)
        row = [r for r, docs, _ in hits for _ in docs]
        docs = np.concatenate([d for _, d, _ in hits] or [np.array([], np.int64)])
        score = np.concatenate([s for _, _, s in hits] or [np.array([], np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), batch.column("id").take(pa.array(docs)), pa.array(score)], names=["row", "id", "score"])

    return run


class Tree:
    """A ball tree over the rows of ``dense``, which it reorders so that each node is a slice of it."""

    def __init__(self, dense: np.ndarray):
        self.dense, self.order = dense, np.arange(len(dense))
        self.spans, self.children = [], []
        center, radius, furthest = [], [], []
        todo = [(0, len(dense), None)]
        while todo:
            start, end, parent = todo.pop()
            node, rows = len(self.spans), self.dense[start:end]
            if parent is not None:
                self.children[parent].append(node)
            c = rows.mean(0) if len(rows) else np.zeros(dense.shape[1])
            squares = np.einsum("ij,ij->i", rows, rows)
            apart = squares - 2 * (rows @ c) + c @ c
            # the difference of near-equal sums may be off by a share of the sums, not of itself
            radius.append(math.sqrt(max(0.0, float((apart + SLACK * (squares + c @ c)).max(initial=0.0)))))
            center.append(c)
            furthest.append(rows.max(0, initial=0.0) - c)
            self.spans.append((start, end))
            self.children.append([])
            if end - start > LEAF_ROWS:
                one = rows[int(apart.argmax())]
                other = rows[int((squares - 2 * (rows @ one)).argmax())]
                side = np.argsort(rows @ (one - other), kind="stable")
                self.dense[start:end], self.order[start:end] = rows[side], self.order[start:end][side]
                middle = (start + end) // 2
                todo += [(start, middle, node), (middle, end, node)]
        self.center, self.radius, self.furthest = np.array(center), np.array(radius), np.array(furthest)

    def bounds(self, wanted: np.ndarray) -> np.ndarray:
        """Nodes x items: no document of the node scores more. ``wanted`` holds an item's entries per row."""
        reach = np.minimum(self.radius[:, None] * np.sqrt((wanted * wanted).sum(1)), self.furthest @ wanted.T)
        return (self.center @ wanted.T + reach) * (1 + SLACK) + 1

    def best(self, items: Items, columns: np.ndarray, floors: np.ndarray, k: int, by_id: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """``(item's row, documents, scores)`` of the ``k`` best at or above the floor, ties by ``by_id``."""
        out = []
        for first in range(0, len(items.rows), ITEMS):
            some = range(first, min(first + ITEMS, len(items.rows)))
            wanted, entries = np.zeros((len(some), len(columns))), []
            for i in some:
                at = np.searchsorted(columns, items.columns[i])
                here = at < len(columns)
                here[here] = columns[at[here]] == items.columns[i][here]
                entries.append((at[here], items.weights[i][here]))
                wanted[i - first, at[here]] = items.weights[i][here]
            bounds = self.bounds(wanted).T
            for i in some:
                docs, scores = self._best_first(bounds[i - first], *entries[i - first], int(floors[i]), k)
                keep = np.lexsort((by_id[docs], -scores))[:k]
                if len(keep):
                    out.append((items.rows[i], docs[keep], scores[keep]))
        return out

    def _best_first(self, bounds: np.ndarray, columns: np.ndarray, weights: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        docs, scores = np.array([], np.int64), np.array([], np.int64)
        heap = [(-bounds[0], 0)] if len(columns) else []
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            start, end = self.spans[node]
            own = self.dense[start:end, columns].astype(np.int64) @ weights
            good = own >= least
            docs, scores = np.concatenate([docs, self.order[start:end][good]]), np.concatenate([scores, own[good]])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                stay = scores >= least
                docs, scores = docs[stay], scores[stay]
        return docs, scores
