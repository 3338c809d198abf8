import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import toxicity
from tests.llm.helpers import docs, prose


def corpus(n=1500):
    r, rows, labels = random.Random(1), [], []
    for i in range(n):
        bad = r.random() < 0.15
        words = prose(i, 30).split()
        if bad:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["grumble", "snarl", "hisser", "moanful", "moanly", "spiteing"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_rows_are_told_apart_by_text_alone(spark):
    rows, labels = corpus()
    truth = dict(labels)
    out = toxicity.toxicity_scores(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    # labels of held-out rows change nothing
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    again = toxicity.toxicity_scores(docs(spark, rows), spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in again} == {r["doc_id"]: round(r["score"], 9) for r in out}


def test_label_model_recovers_rates_and_joins_copies():
    r = np.random.default_rng(0)
    n, rates = 40_000, [(0.7, 0.05), (0.6, 0.02), (0.5, 0.1), (0.8, 0.3)]
    y = r.random(n) < 0.2
    votes = np.stack([r.random(n) < np.where(y, a, b) for a, b in rates])
    votes = np.vstack([votes, votes[0]])  # a voter that repeats another
    code = sum(v.astype(np.int64) << k for k, v in enumerate(votes))
    patterns, counts = np.unique(code, return_counts=True)
    model = toxicity.LabelModel(5).fit(patterns, counts.astype(float), np.zeros((2, len(patterns))))
    assert sorted(map(len, model.blocks)) == [1, 1, 1, 2] and abs(model.prior - 0.2) < 0.05
    for k in (1, 2, 3):
        block = next(i for i, b in enumerate(model.blocks) if b == [k])
        assert abs(model.rates[block][1][1] - rates[k][0]) < 0.06 and abs(model.rates[block][0][1] - rates[k][1]) < 0.04
    assert (model.posterior(code) > 0.5).astype(int).tolist().count(1) > 0.5 * y.sum()


def test_linear_classifier_separates():
    r = np.random.default_rng(1)
    hits = [sorted(set(r.integers(0, 20, 4).tolist())) for _ in range(2000)]
    target = np.array([float(3 in h or 7 in h) for h in hits])
    w = toxicity.fit_linear(hits, target, np.ones(len(hits)), 20)
    z = np.array([w[-1] + sum(w[i] for i in h) for h in hits])
    assert ((z > 0) == (target > 0.5)).mean() > 0.99


@pytest.mark.parametrize("labels", [[], [(0, 1)], [(1, None), (2, 0)]])
def test_nulls_empties_and_missing_labels(spark, labels):
    rows = docs(spark, [None, "", (None, "x"), (4, "y"), (4, "y")]).withColumnRenamed("lang", "votes")
    out = toxicity.toxicity_scores(rows, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert out.count() == 5 and out.where("score IS NULL OR held_out IS NULL").count() == 0


def test_empty_texts_score_low_and_long_ones_count_whole(spark):
    rows, labels = corpus(800)
    far = prose(5, 20_000) + " grumble snarl hisser"
    df = docs(spark, rows + [(9001, ""), (9002, None), (9003, far)])
    out = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(df, spark.createDataFrame(labels, "doc_id long, toxic int")).where(F.col("doc_id") > 9000).collect()}
    assert out[9001] == out[9002] < 0.5 < out[9003]


def test_rare_words_are_mined_from_all_labelled_rows(spark, monkeypatch):
    """A word in few toxic rows counts however many rows are labelled and however few the classifier is fitted on."""
    monkeypatch.setattr(toxicity, "LABELLED_ROWS", 400, raising=False)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 400)
    rows, labels = corpus(3000)
    rare = [i for i in range(5000, 5030)]
    rows += [(i, prose(i, 30) + " zorgling") for i in rare]
    labels += [(i, 1) for i in rare]
    out = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert any(out[i]["held_out"] for i in rare) and all(out[i]["predicted"] for i in rare)
    truth = dict(labels)
    assert sum(r["predicted"] == truth[i] for i, r in out.items() if r["held_out"]) >= 0.97 * sum(r["held_out"] for r in out.values())


def test_no_strong_word_is_cut(spark, monkeypatch):
    """Strong words vote and weigh however many outrank them, also where labelled rows come a hundred times."""
    monkeypatch.setattr(toxicity, "FEATURES", 5)
    rows, labels = corpus(1500)
    rare = list(range(5000, 5030))
    rows += [(i, prose(i, 30) + " zorgling") for i in rare]
    labels += [(i, 1) for i in rare]
    for times in (1, 100):
        more = [(100_000 * k + i, t) for k in range(times if times == 1 else 8) for i, t in rows]
        taught = [(100_000 * k + i, y) for k in range(times if times == 1 else 8) for i, y in labels] * (1 if times == 1 else 12)
        got = toxicity.toxicity_scores(docs(spark, more), spark.createDataFrame(taught, "doc_id long, toxic int"))
        out = {r["doc_id"]: r["predicted"] for r in got.where(F.col("doc_id").isin(rare)).collect()}
        assert len(out) == 30 and all(out.values())


def test_packed_words_and_filter_agree_with_spark(spark):
    import xxhash

    names = ["wa", "5hello", "4été", "w" + "x" * 300]
    got = spark.createDataFrame([(n,) for n in names], "f string").select("f", F.pmod(F.xxhash64("f"), F.lit(toxicity.MARKS)).alias("m")).collect()
    assert all(r["m"] == xxhash.xxh64_intdigest(r["f"], 42) & (toxicity.MARKS - 1) for r in got)
    bags = toxicity.word_bags(docs(spark, ["b A b!", None, "", "ß é_1 x"])).orderBy("row")
    assert [sorted(s) for s in toxicity._unpacked([type("X", (), {"as_py": lambda self, w=r["words"]: bytes(w)})() for r in bags.collect()])] == [
        ["wa", "wb"], [], [], ["wx", "wß", "wé"]]
