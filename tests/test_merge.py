"""Chunk merging against a small model of the rule, and its associativity on equal kinds."""

import json
from functools import reduce

from hypothesis import HealthCheck, given, settings, strategies as st

from paperloom.operators.chunks import merge_chunks


def kind(v):
    return "n" if isinstance(v, (int, float)) else type(v).__name__


def join(old, new):
    """One step of the rule on two values that are both present."""
    match kind(old) if kind(old) == kind(new) else None:
        case "dict":
            return {k: join(old[k], new[k]) if k in old and k in new else old.get(k, new.get(k)) for k in {**old, **new}}
        case "list":
            return [*old, *new]
        case "str":
            return " ".join((old + " " + new).split())
        case "n":
            return old + new
    return new or old


def run(spark, docs, levels=3):
    rows = [(d, i, json.dumps(c)) for d, chunks in enumerate(docs) for i, c in enumerate(chunks)]
    df = spark.createDataFrame(rows, "id int, chunk_idx int, data string").repartition(4)
    return {r.id: json.loads(r.json) for r in merge_chunks(df, levels=levels).collect()}


VALUES = st.one_of(
    st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from(["", " a  b", "c"]),
    st.lists(st.integers(0, 2), max_size=2), st.dictionaries(st.sampled_from("xy"), st.integers(0, 2), max_size=2),
)
CHUNKS = st.lists(st.dictionaries(st.sampled_from(["a", "b", "c/d"]), VALUES, max_size=3), min_size=1, max_size=4)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(CHUNKS, min_size=30, max_size=30))
def test_merge_follows_the_rule(spark, docs):
    want = {i: reduce(join, chunks) for i, chunks in enumerate(docs)}
    got = run(spark, docs)
    assert {k: (v, json.dumps(v, sort_keys=True)) for k, v in got.items()} == {
        k: (v, json.dumps(v, sort_keys=True)) for k, v in want.items()
    }


def test_kinds_that_differ(spark):
    docs = [
        [{"v": None}, {"v": ""}, {"v": " x  y "}],
        [{"v": 1}, {"v": 0.5}, {"v": True}],
        [{"v": {"x": 1}}, {"v": "s"}, {"v": {"x": 2}}, {"v": {"x": 3}}],
        [{"v": "s"}, {"v": 0}, {"v": "t"}],
        [{"v": 5.0}],
        [{}, {}],
    ]
    want = {i: reduce(join, c) for i, c in enumerate(docs)}
    assert run(spark, docs) == want
    assert run(spark, docs, levels=0) == want


def test_records_of_any_depth_merge_by_one_plan(spark):
    """What lies below the plan's levels follows the same rule."""
    def deep(n, leaf):
        return {"d": deep(n - 1, leaf), f"only{leaf['i']}": n} if n else leaf

    docs = [[deep(200, {"i": i, "l": [i], "s": f"t{i}", "m": None if i else {"x": 1}}) for i in range(3)], [deep(2, {"i": 1}), {"d": 0}, deep(3, {"i": 2})]]
    want = {i: reduce(join, c) for i, c in enumerate(docs)}
    assert run(spark, docs) == want
    assert run(spark, docs, levels=1) == want


def test_merging_in_parts_gives_the_same(spark):
    chunks = [{"n": i, "l": [i], "s": f"t{i}", "o": {"k": i}} for i in range(6)]
    whole = run(spark, [chunks])[0]
    halves = run(spark, [chunks[:2], chunks[2:]])
    assert run(spark, [[halves[0], halves[1]]])[0] == whole
