import random
import re

import numpy as np
import pytest
import xxhash

from paperloom.llm import simhash
from tests.llm.helpers import WORD, docs, prose


def mark(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(marks):
    """{fingerprint: least index reachable} by comparing all pairs."""
    at, up = list(marks), {m: m for m in marks}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(at):
        for b in at[:i]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    return {m: find(m) for m in at}


def linked(spark, marks):
    """Whether the links of a list of fingerprints connect exactly what all pairs do."""
    signed = [(int(np.uint64(m).view(np.int64)),) for m in marks]
    got = {m: m for m in marks}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in simhash.near_links(spark.createDataFrame(signed, "fp long")).collect():
        a, b = r["a"] % 2**64, r["b"] % 2**64
        got[find(a)] = find(b)
    want = classes(marks)
    sets = lambda label: {frozenset(m for m in marks if label[m] == x) for x in label.values()}
    assert sets({m: find(m) for m in marks}) == sets(want)


def cluster(seed, n, flips):
    r = random.Random(seed)
    base = r.getrandbits(64)
    return {base} | {base ^ sum(1 << i for i in r.sample(range(64), r.randrange(flips + 1))) for _ in range(n)}


def test_fingerprints_and_components(spark):
    base = prose(1, 300)
    texts = [None, "", "\n ", "One", "one", "one two", "ONE  two\tthree", "é à ñ 語", base, base.upper(), base + " end", prose(2, 5),
             "x " + base, base.replace(" ", "\n"), base.replace("w1 ", "ww ", 1), prose(3, 70_000), None]
    texts += [" ".join(base.split()[:-k]) for k in range(1, 15)]
    got = {r["doc_id"]: r for r in simhash.near_components(docs(spark, texts)).collect()}
    marks = [mark(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{m:016x}" for m in marks]
    of = classes(list(dict.fromkeys(marks)))
    assert [got[i]["component_id"] for i in range(len(texts))] == [min(j for j, m in enumerate(marks) if of[m] == of[x]) for x in marks]


def test_sets_of_positions_cover_any_five_shared_bytes():
    from itertools import combinations
    for width in range(1, 6):
        assert all(any(set(f) <= set(five) for f in simhash.families(width)) for five in combinations(range(8), 5))
    assert [simhash.entry_bytes(n) for n in (10, 10**5, 10**7, 10**12)] == sorted(simhash.entry_bytes(n) for n in (10, 10**5, 10**7, 10**12))


@pytest.mark.parametrize("limit", [512, 20, 1])
def test_links_equal_all_pairs(spark, monkeypatch, limit):
    """Long lists go on to more bytes, and with a limit of one to the neighbourhoods of values."""
    monkeypatch.setattr(simhash, "LIST", limit)
    n = 60 if limit == 1 else 200
    marks = set().union(cluster(1, n, 5), cluster(2, n, 8), cluster(3, 30, 3), [0, 1, 7, 15, 2**64 - 1], (random.Random(4).getrandbits(64) for _ in range(n)))
    linked(spark, sorted(marks))


def test_empty_null_ids_and_other_columns(spark):
    rows = docs(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "q"), (7, None)]).withColumnRenamed("lang", "fp").withColumnRenamed("source", "id")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_components(rows).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 7), (None, 5), (None, None)]
    assert simhash.near_components(rows.limit(0)).count() == 0
