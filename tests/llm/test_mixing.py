import math

from paperloom.llm import mixing
from tests.llm.helpers import SCHEMA, docs, prose


def model_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(w[s] for s in free), 1)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def corpus(spark):
    rows, i = [], 0
    for k, (source, n) in enumerate([("a", 900), ("b", 30), (None, 60), ("c", 300), ("ä", 5)]):
        for _ in range(n):
            rows.append((i, prose(i, 5 + i * 7 % 60), "en", source, 0))
            i += 1
    return spark.createDataFrame(rows, SCHEMA), rows


def test_targets_bounds_and_taken_words(spark):
    df, rows = corpus(spark)
    got = mixing.document_copies(df, carry=["source"]).select("__doc.*", "size", "source_size", "target", "copies").collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want = model_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]])
        assert 0 <= r["copies"] <= 3 and abs(r["copies"] - r["target"] / r["source_size"]) < 1
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(70, 0.02 * want[s])
    again = mixing.document_copies(df.repartition(7)).select("__doc.doc_id", "copies").collect()
    assert {tuple(r) for r in again} == {(r["doc_id"], r["copies"]) for r in got}


def test_many_buckets_give_the_same_mix(spark, monkeypatch):
    df, _ = corpus(spark)
    one = {tuple(r) for r in mixing.document_copies(df).select("__doc.doc_id", "copies").collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert {tuple(r) for r in mixing.document_copies(df).select("__doc.doc_id", "copies").collect()} == one


def test_nulls_empties_repeats_and_names(spark):
    rows = docs(spark, [(None, None), (1, ""), (2, "x y"), (2, "x y"), (3, "z")]).withColumnsRenamed({"lang": "key", "n_chars": "size"})
    mixed = mixing.mix_sources(rows)
    assert mixed.columns == rows.columns
    assert sorted(r["doc_id"] for r in mixed.collect()) == [2, 2, 3]  # one source: target is its size
    assert mixing.mix_sources(rows.limit(0)).count() == 0
    assert mixing.document_copies(docs(spark, [None, ""])).where("copies <> 0 OR target <> 0").count() == 0
