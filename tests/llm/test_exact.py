import hashlib

from pyspark.sql import functions as F

from paperloom.llm.exact import drop_copies, exact_groups
from tests.llm.helpers import docs


def result(df):
    return {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()}


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_case_nulls_and_order(spark):
    rows = docs(spark, ["Aé", "aé", "aÉ", None, "", "x"])
    got = result(exact_groups(rows, keep="max"))
    assert got[(0, sha("aé"))] == (1, 2, False) and got[(1, sha("aé"))] == (1, 2, True)
    assert got[(2, sha("aÉ"))] == (2, 1, True)  # only A-Z change case
    assert got[(3, sha(""))] == (4, 2, False) and got[(4, sha(""))] == (4, 2, True)
    assert result(exact_groups(rows))[(1, sha("aé"))] == (0, 2, False)


def test_collisions_are_told_apart(spark):
    texts = ["aa", "bb", "aa", "cc", "bb", "cc", "d"]
    got = result(exact_groups(docs(spark, texts), keep="max", key=F.substring(F.lit("k"), 1, 1)))
    assert {k[0]: v for k, v in got.items()} == {
        0: (2, 2, False), 2: (2, 2, True), 1: (4, 2, False), 4: (4, 2, True), 3: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True)}


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = docs(spark, [(7, "t"), (7, "t"), (None, "t"), (None, "u")]).withColumnsRenamed({"lang": "__key", "source": "kept"})
    got = exact_groups(rows, keep="max").collect()
    assert [r["keep_id"] for r in got if r["text_sha256"] == sha("t")] == [7, 7, 7]
    assert sum(r["kept"] for r in got) == 2
    left = drop_copies(rows)
    assert left.columns == rows.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("7", "t"), ("None", "u")]


def test_empty_table_and_one_large_group(spark):
    assert exact_groups(docs(spark, [])).count() == 0
    got = exact_groups(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")), keep="max")
    assert got.where("kept").count() == 1 and got.agg(F.max("group_size")).first()[0] == 3000
