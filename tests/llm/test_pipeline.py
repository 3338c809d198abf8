import re
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm.pieces import MODEL
from tests.llm.helpers import SCHEMA, near_model, prose


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        rows[name] = docs.collect()
        if name != "token ids":
            assert docs.columns == before.columns
    good = rows["quality rules"]
    assert 0 < len(good) < 200
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    first = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        first.setdefault(lower(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows["exact dedup"]) == sorted(first.values())
    model = near_model([(r["doc_id"], r["text"]) for r in rows["exact dedup"]])
    assert sorted(r["doc_id"] for r in rows["near dedup"]) == sorted({c for _, c in model.values()})
    near = {r["doc_id"]: r for r in rows["near dedup"]}
    copies = Counter(r["doc_id"] for r in rows["source mix"])
    assert set(copies) <= set(near) and max(copies.values()) <= 3
    words = lambda ids: sum(len(near[i]["text"].split()) * k for i, k in ids)
    assert abs(words(copies.items()) - words((i, 1) for i in near)) < 0.2 * words((i, 1) for i in near)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert Counter(r["doc_id"] for r in rows["token ids"]) == copies
    assert all(r["ids"] == library.encode(near[r["doc_id"]]["text"]) and r["round_trip"] for r in rows["token ids"])


def test_run_is_the_stages_in_turn(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mix", "token ids"]
    assert corpus_pipeline.run(spark, sf).columns[:4] == ["doc_id", "lang", "source", "n_ids"]


def test_stages_take_nulls_repeated_rows_long_texts_and_clashing_names(spark, sf):
    """Every stage on its predecessor's rows, with columns named like the stages' own; then all on an empty table."""
    long = prose(1, 30_000, 5000)
    texts = [prose(i, 80) for i in range(2, 30)]
    rows = [(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None), (100, None, "en", "s1", None), (101, "", None, "s2", 0), rows[3], rows[3],
             (102, texts[5].upper(), "en", None, 1), (103, texts[6] + " tail", "de", "s1", 1), (104, long, "en", "s3", len(long)), (105, long + " x", "en", "s3", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("z") for n in ("ids", "label", "cls", "copies", "kept", "id", "__doc")})
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        if name != "token ids":
            assert docs.columns == before.columns and docs.count() > 0
        if name == "exact dedup":
            texts_left = [(r["text"] or "").lower() for r in docs.collect()]
            assert len(texts_left) == len(set(texts_left))
        if name == "near dedup":
            assert {104, 105} - {r["doc_id"] for r in docs.collect()} == {105}
        assert stage(spark, before.limit(0), sf).count() == 0
    assert docs.where("NOT round_trip").count() == 0
