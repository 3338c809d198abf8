import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import jaccard
from paperloom.llm.graph import components
from tests.llm.helpers import docs, near_model, prose


def edited(text, seed, share):
    r = random.Random(seed)
    words = text.split()
    at = r.randrange(max(1, int(len(words) * (1 - share))))
    words[at : at + int(len(words) * share)] = [f"x{r.randrange(10**6)}" for _ in range(int(len(words) * share))]
    return " ".join(words)


def corpus(seed=0, groups=12):
    r, texts = random.Random(seed), [None, "", " \n", "one", "One", "one two", "a b c d e", "A b c d e", "a b c d e f"]
    common = prose(99, 40)
    for g in range(groups):
        base = prose(100 * seed + g, r.choice([6, 9, 14, 30, 80, 300, 1500]))
        texts += [base, base.upper(), *(edited(base, s, r.choice([0.02, 0.05, 0.09, 0.11, 0.2])) for s in range(5))]
        texts.append(common + " " + prose(5000 + g, r.choice([5, 10, 30])))
    return texts


def run(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(docs(spark, rows)).collect()}
    assert got == near_model(list(enumerate(rows)))


def test_links_equal_all_pairs(spark):
    run(spark, corpus())


def test_frequent_signatures_leave_it_to_neighbourhoods(spark, monkeypatch):
    """With no signature frequent enough to be left out but one per class, later steps find the rest."""
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    run(spark, corpus(1, 8))


def test_several_buckets_and_spread_signatures(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 40)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "CENTER_ROWS", 2)
    monkeypatch.setattr(jaccard, "HELD_ROWS", 3)
    run(spark, corpus(2, 6))


@pytest.mark.parametrize("n", [1, 4, 5, 8, 33, 400])
def test_allocation_misses_no_partner(n):
    """Any two sets above the threshold share a signature unless one of them is short of usable ones."""
    r = np.random.default_rng(n)
    for _ in range(60):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        cut, add = r.integers(0, n // 9 + 1), r.integers(0, n // 9 + 1)
        b = np.unique(np.concatenate([r.permutation(a)[cut:], r.integers(0, 2**63, add).astype(np.uint64)]))
        if jaccard.linked(a, b) and not (jaccard.short(a) and jaccard.short(b)):
            assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size


def test_one_deletion_is_found():
    tokens = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = lambda t: set(jaccard.neighbourhoods(np.sort(t))[2])
    assert keys(tokens) & keys(tokens[:-1])


def test_stage_keeps_one_row_of_each_group(spark):
    base = prose(1, 50)
    rows = docs(spark, [(None, base), (3, base), (3, base), (2, base + " more"), (9, ""), (9, ""), (8, None)]).withColumnRenamed("lang", "h")
    left = jaccard.drop_near_copies(rows)
    assert left.columns == rows.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 8, 9]
    assert jaccard.drop_near_copies(rows.limit(0)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(600, 700)] + [(900 + i, 900 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    edges = [(a, b) if r.random() < 0.5 else (b, a) for a, b in edges]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {500: 500} | {i: 500 for i in range(600, 700)} | {900 + i: 900 for i in range(9)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sketched(seed, sizes=(40, 44, 100, 130)):
    """Rows ``guest, cls, label, n, body`` of sets that differ by about as much as the threshold allows."""
    r = np.random.default_rng(seed)
    base, rows = r.integers(0, 2**63, 400).astype(np.uint64), []
    for i in range(40):
        n = sizes[i % len(sizes)]
        s = np.unique(np.concatenate([base[:n][r.random(n) > 0.12], r.integers(0, 2**63, n // 9).astype(np.uint64)]))
        rows.append((0, i, i % 7, len(s), jaccard.sketch(s)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_meeting_classes_are_held_against_whole_sketches(seed):
    """Only pairs that whole sketches leave come out of a task, by blocks or one by one; folded ones alone leave more."""
    rows = sketched(seed)
    body = {r[1]: (r[3], np.frombuffer(r[4], np.uint64)) for r in rows}
    want = {(a[1], b[1]) for a in rows for b in rows if a[2] != b[2] and jaccard.may_link(body[a[1]], body[b[1]])}
    folded = {(a[1], b[1]) for a in rows for b in rows if a[2] != b[2] and jaccard.may_link((a[3], jaccard._half(a[4])), (b[3], jaccard._half(b[4])))}
    assert want < folded
    assert set(jaccard._by_blocks(rows, rows)) == set(jaccard._one_by_one(rows, rows)) == want


def test_margin_counts_signatures():
    for n in (1, 5, 60, 700):
        s = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        assert jaccard.margin(s) == min(len(segs) - h for _, h, segs, _, _ in jaccard.subsets(s))


def test_only_signatures_with_several_labels_stay_open(spark):
    groups = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 12), (3, 13)], "sig long, cls long")
    labels = spark.createDataFrame([(10, 10), (11, 10)], "node long, label long")
    assert {tuple(r) for r in jaccard._open(groups, labels).collect()} == {(2, 10), (2, 12), (3, 12), (3, 13)}


def test_rows_that_stay_are_not_shuffled(spark):
    """Of a thousand rows without copies none is dealt out again after the join; repeated ones come once."""
    rows = docs(spark, [*(prose(i, 20, 10**6) for i in range(1000)), (0, prose(0, 20, 10**6)), (5000, prose(7, 20, 10**6))])
    left = jaccard.drop_near_copies(rows)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(1000))
    plan = left._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Union":
        assert plan.children().size() == 1
        plan = plan.children().apply(0)
    stay = plan.children().apply(0).toString()
    assert "Join" not in stay and "Aggregate" not in stay
