import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import balltree
from tests.llm.helpers import docs, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def model(rows, items, k=20):
    """Every item against every document."""
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c, c.total()) for i, c in counts if c]
    size, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 25 + 25 * n * size // length
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def got(spark, rows, items, k=20):
    table = spark.createDataFrame(items, "item_id long, text string, id string, row int")if len(items[0]) == 4 else spark.createDataFrame(items, "item_id long, text string")
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in balltree.search(docs(spark, rows), table, k).collect())


def corpus(seed, n):
    r = random.Random(seed)
    rows = [(i, prose(seed * 1000 + i, r.choice([1, 3, 20, 80, 400]), r.choice([30, 400, 3000]))) for i in range(n)]
    rows += [(n + i, t) for i, t in enumerate([None, "", "?!", "W1 É.w2-é", rows[3][1], rows[3][1].upper(), prose(7, 30_000), "語 語"])]
    return rows + [rows[3], (None, rows[3][1])]


def queries(seed, rows, n=12):
    r = random.Random(seed)
    out = [(i, prose(seed * 77 + i, r.choice([1, 4, 30]), r.choice([30, 400, 3000]))) for i in range(n)]
    return out + [(n, rows[3][1]), (n, "w1 w1 w1"), (n + 1, None), (n + 2, ""), (n + 3, "nowhere to-be-found"), (None, "É é 語"), (n + 4, rows[5][1].upper())]


def test_results_equal_scoring_everything(spark):
    rows = corpus(1, 300)
    items = queries(2, rows)
    assert got(spark, rows, items) == model(rows, items)
    assert got(spark, rows, items, 3) == model(rows, items, 3)


def test_many_trees_blocks_and_floors(spark, monkeypatch):
    monkeypatch.setattr(balltree, "TREE_ROWS", 40)
    monkeypatch.setattr(balltree, "LEAF_ROWS", 4)
    monkeypatch.setattr(balltree, "BLOCK_TERMS", 100)
    monkeypatch.setattr(balltree, "FLOOR_ROWS", 60)
    monkeypatch.setattr(balltree, "ITEMS", 3)
    rows = corpus(3, 250)
    items = queries(4, rows)
    assert got(spark, rows, items, 5) == model(rows, items, 5)


def test_empty_tables_and_clashing_names(spark):
    none = docs(spark, [(1, "a b")])
    items = spark.createDataFrame([(1, "a", "x", 3)], "item_id long, text string, id string, row int")
    assert balltree.search(none.limit(0), items).count() == 0
    assert balltree.search(none, items.limit(0)).count() == 0
    assert balltree.search(docs(spark, [(1, None), (2, "..")]), items).count() == 0
    rows = docs(spark, [(1, "a b"), (2, "c"), (3, "a a")]).withColumnRenamed("lang", "id").withColumnRenamed("source", "terms")
    want = model([(1, "a b"), (2, "c"), (3, "a a")], [(1, "a")])
    assert Counter(map(tuple, balltree.search(rows, items).collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_and_prune(seed):
    r = np.random.default_rng(seed)
    dense = r.integers(0, 10**6, (500, 60)) * (r.random((500, 60)) < 0.1) + 0.0
    dense[:250, :30] = 0
    dense[250:, 30:] = 0
    tree = balltree.Tree(dense.copy())
    wanted = r.integers(0, 20_000, (9, 60)) * (r.random((9, 60)) < 0.2) + 0.0
    bounds, scores = tree.bounds(wanted), tree.dense.astype(np.int64) @ wanted.astype(np.int64).T
    for node, (a, b) in enumerate(tree.spans):
        assert (scores[a:b] <= bounds[node]).all()
    assert (np.sort(tree.order) == np.arange(500)).all() and (dense[tree.order] == tree.dense).all()
    leaves = [i for i, c in enumerate(tree.children) if not c]
    kth = np.sort(scores, 0)[-5]
    assert (bounds[leaves] < kth).any()
