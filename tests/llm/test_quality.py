import random

from pyspark.sql import functions as F

from paperloom.llm import quality
from tests.llm.helpers import SCHEMA, docs, prose, statistics


def test_statistics_match_a_plain_count(spark):
    r = random.Random(5)
    texts = [None, "", "  \n\t", "a", "a b c", "a b c a b c", "x x x x x x", "é# <b>\nl\nl\n \n \nl2", "a\x0bb\x0cc d"]
    texts += ["".join(r.choice("ab \n#é") for _ in range(r.randrange(200))) for _ in range(60)]
    texts.append(prose(1, 20_000, 60))
    got = quality.base_statistics(docs(spark, texts)).select("doc_id", "__stats.*").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: statistics(t) for i, t in enumerate(texts)}


def corpus(n=600):
    rows = [(i, prose(i, 120, 5000).replace("w3", ".\nW3"), "en", f"s{i % 2}", 0) for i in range(n)]
    bad = ["*** ".join(prose(9, 100, 5000).split()), prose(8, 100, 5000).upper().replace(" ", "!! "), prose(7, 30), " ".join(["go on"] * 60)]
    return rows + [(n + i, t, "en", "s0", 0) for i, t in enumerate(bad)]


def test_outliers_go_and_clean_rows_stay(spark):
    rows = spark.createDataFrame(corpus(), SCHEMA)
    got = {r["doc_id"]: r for r in quality.judge(rows, carry=["doc_id"]).select("__doc.doc_id", "base_failed", "kept", "distance").collect()}
    assert all(got[i]["kept"] for i in range(600))
    assert [got[600 + i]["kept"] for i in range(4)] == [False] * 4
    assert [got[600 + i]["base_failed"] for i in range(4)] == [False, False, True, True]
    assert max(got[i]["distance"] for i in range(600)) < quality.CUT < min(got[600]["distance"], got[601]["distance"])


def test_nulls_small_groups_and_clashing_names(spark):
    rows = docs(spark, [None, "", (5, prose(1, 80)), (5, prose(1, 80)), (6, prose(2, 80), None, None, None)]).withColumnRenamed("n_chars", "__w")
    got = quality.keep_good(rows)  # too few rows for any estimate: only the limits decide
    assert got.columns == rows.columns and sorted(r["doc_id"] for r in got.collect()) == [5, 5, 6]
    assert quality.keep_good(rows.limit(0)).count() == 0


def test_estimate_is_the_robust_one(spark):
    """A third of gross outliers neither moves the centre nor inflates the distances of the rest."""
    r = random.Random(2)
    clean = [[r.gauss(1, 0.3) for _ in range(6)] for _ in range(2000)]
    odd = [[r.gauss(9, 0.1) for _ in range(6)] for _ in range(450)]
    vectors = spark.createDataFrame([("g", v) for v in clean + odd], "g string, v array<double>")
    final = quality._estimates(vectors)
    assert all(abs(m - 1) < 0.1 for m in final.first()["mean"])
    far = vectors.join(final, "g").select((quality._distance() / F.col("scale")).alias("d"))
    assert far.where("d > 60").count() == 450


def test_hashes_that_lie_are_recounted(spark):
    """The slow path, taken when a neighbour in hash order is another window, gives the same count."""
    texts = ["a b c d a b c", "q q q q", prose(3, 300, 9)]
    rows = quality.base_statistics(docs(spark, texts))
    plan = rows._jdf.queryExecution().toString()
    assert "__lied" in plan
    assert {r[0]: r[1] for r in rows.select("doc_id", "__stats.n_repeat_words").collect()} == {i: statistics(t)[4] for i, t in enumerate(texts)}


def test_junk_of_nearly_half_a_group_is_rejected(spark):
    """Symbol junk as in the given documents."""
    r = random.Random(7)
    centre, spread = [1.75, 0.02, 0.15, 0.35, 0.05, 0.1], [0.05, 0.03, 0.04, 0.05, 0.05, 0.08]
    rows = []
    for share in (0.0, 0.3, 0.4, 0.45):
        for i in range(3000):
            v = [r.gauss(m, s) for m, s in zip(centre, spread)]
            junk = i < share * 3000
            if junk:
                v[0], v[1] = r.gauss(2.23, 0.05), r.gauss(1.73, 0.05)
            rows.append((str(share), junk, v))
    vectors = spark.createDataFrame(rows, "g string, junk boolean, v array<double>")
    final = quality._estimates(vectors.select("g", "v"))
    judged = vectors.join(final, "g").select("junk", (quality._distance() / F.col("scale") > quality.CUT).alias("out"))
    assert judged.where("junk != out").count() == 0
