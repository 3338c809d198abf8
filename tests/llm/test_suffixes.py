import hashlib
import random

import numpy as np

from paperloom.llm import suffixes
from tests.llm.helpers import docs, prose


def model(rows, length=suffixes.LENGTH):
    """Every window in order, one by one."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(b[k : k + length])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((_, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    got = suffixes.repeated_spans(docs(spark, rows)).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == model(rows)


def corpus(seed):
    r = random.Random(seed)
    passage = prose(50, 60)
    texts = [None, "", "x" * 99, "x" * 100, "x" * 500, "ab" * 400, "é" * 120, passage]
    for i in range(14):
        base = prose(seed * 100 + i, r.choice([20, 60, 200]))
        texts += [base, base, base + "!", base[: len(base) // 2] + " cut " + base[len(base) // 2 :]]
        texts += [prose(i + 900, 20) + passage + prose(i + 800, 20), ("line " * 30 + str(i) + "\n") * 5]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_removed_bytes_equal_a_scan_of_all_windows(spark):
    run(spark, corpus(1))


def test_hot_anchors_small_collections_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "PART_BYTES", 4000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(suffixes, "COLLECTION_BYTES", 500)
    run(spark, corpus(2))


def test_nulls_and_repeated_ids(spark):
    t = prose(1, 40)
    rows = docs(spark, [(None, t), (5, t), (5, t), (2, "short")]).withColumnRenamed("lang", "cls")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffixes.repeated_spans(rows).collect())
    n = len(t)
    assert got == [("2", 0), ("5", 0), ("5", n), ("None", n)]
    assert suffixes.repeated_spans(rows.limit(0)).count() == 0


def test_spans_are_what_was_removed(spark):
    t = prose(3, 40)
    got = {r["doc_id"]: r["spans"] for r in suffixes.repeated_spans(docs(spark, [t, "intro " + t])).collect()}
    assert got[0] == [] and [(s["start"], s["stop"]) for s in got[1]] == [(6, 6 + len(t))]


def test_construction_equals_a_sort_of_all_suffixes():
    r = random.Random(3)
    for _ in range(150):
        texts = [bytes(r.choice(b"ab\xff" if r.random() < 0.1 else b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 8))]
        bwt, suffix, common = suffixes.build(texts, 100)
        rows, base = [], 0
        for k, t in enumerate(texts):
            rows += [(t[o:], k, base + o, t[o - 1] + 1 if o else 0) for o in range(len(t) + 1)]
            base += len(t)
        rows.sort(key=lambda x: (x[0], x[1]))
        shared = [0] + [next((i for i, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(rows, rows[1:])]
        assert [x[2] for x in rows] == suffix.tolist() and [x[3] for x in rows] == bwt.tolist() and shared == common.tolist()


def test_long_texts_are_cut_into_chunks(monkeypatch):
    text = prose(4, 600).encode()
    whole = {(int(a) + o, int(z) + o) for o, s, e, _ in suffixes.pieces(text) for a, z in zip(s, e)}
    windows = {w for a, z in whole for w in range(a, z + 1)}
    monkeypatch.setattr(suffixes, "CHUNK", 512)
    suffixes._powers.cache_clear()
    parts = {w for o, s, e, _ in suffixes.pieces(text) for a, z in zip(s, e) for w in range(int(a) + o, int(z) + o + 1)}
    suffixes._powers.cache_clear()
    assert windows == parts == set(range(len(text) - suffixes.LENGTH + 1))


def test_texts_short_in_characters_and_long_in_bytes(spark):
    r = random.Random(8)
    chinese = ["".join(chr(0x4E00 + r.randrange(5000)) for _ in range(60)) for _ in range(3)]
    russian = "".join(chr(0x430 + r.randrange(32)) for _ in range(90))
    longer = ["".join(chr(0x4E00 + r.randrange(5000)) for _ in range(150)) + t for t in (chinese[1], "")]
    rows = [chinese[0], "before " + chinese[0] + " after " + prose(1, 40), longer[0], chinese[1], russian, russian + prose(2, 40), chinese[2][:20] * 2 + chinese[2][:20]]
    run(spark, list(enumerate(rows)))
