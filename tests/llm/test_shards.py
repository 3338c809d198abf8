from collections import Counter

from pyspark.sql import functions as F

from paperloom.llm.shards import _hash, lookup_table, place, slot_of
from tests.llm.helpers import docs


def model(shards, size):
    """Turns over explicit preference lists."""
    orders = []
    for s in shards:
        offset, skip = _hash(s, "offset") % size, _hash(s, "skip") % (size - 1) + 1
        orders.append([(offset + j * skip) % size for j in range(size)])
    table = {}
    while len(table) < size:
        for i, order in enumerate(orders):
            if len(table) < size:
                table[next(s for s in order if s not in table)] = i
    return [table[i] for i in range(size)]


def test_table_is_filled_in_turns_and_even():
    names = [f"s{i}" for i in range(7)]
    assert lookup_table(names, 101) == model(names, 101)
    loads = Counter(lookup_table(names))
    assert max(loads.values()) - min(loads.values()) <= 1


def test_few_keys_move_when_a_shard_goes():
    names = [f"s{i}" for i in range(20)]
    a, b = lookup_table(names), lookup_table(names[:-1])
    moved = sum(x != y for x, y in zip(a, b) if x != 19)
    assert moved < 0.1 * len(a)


def test_rows_keep_and_nulls_have_a_place(spark):
    df = docs(spark, [(None, "a"), (None, "b"), (4, "c"), (4, "c")]).withColumnRenamed("lang", "slot")
    got = place(df, F.col("doc_id"), ["x", "y", "z"], 11).collect()
    table = lookup_table(["x", "y", "z"], 11)
    assert len(got) == 4 and all(r["shard"] == "xyz"[table[r["slot"]]] for r in got)
    assert len({r["slot"] for r in got if r["__row"]["doc_id"] == 4}) == 1
    assert place(df.limit(0), F.col("doc_id"), ["x"], 11).count() == 0
    assert spark.range(5000).select(slot_of(F.col("id"), 11).alias("s")).distinct().count() == 11
