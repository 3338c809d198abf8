"""Skew-safe orderings against plain windows, with one key holding most rows."""

from pyspark.sql import Window as W, functions as F

from paperloom.functions import skew
from paperloom.operators import aggregates as A
from paperloom.operators import ordering as O


def hot_rows(spark, n=4000):
    """Two thirds of the rows under one key, many of them at the same second."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 < 2, F.lit(1)).otherwise(i % 50).alias("document_id"),
        i.alias("correction_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.floor(F.pmod(i * 7919, F.lit(90000)) / 30) * 30).alias("ts"),
        F.concat(F.lit("d"), i).alias("corrected_data"),
    )


def test_row_numbers(spark):
    rows = hot_rows(spark)
    w = W.partitionBy("document_id").orderBy("ts", "correction_id")
    want = {(r.correction_id, r.n) for r in rows.withColumn("n", F.row_number().over(w)).collect()}
    assert {(r.correction_id, r.correction_number) for r in O.number_corrections(rows).collect()} == want


def test_previous_value(spark):
    rows = hot_rows(spark)
    w = W.partitionBy("document_id").orderBy("ts", "correction_id")
    want = {(r.correction_id, r.p) for r in rows.withColumn("p", F.lag("corrected_data").over(w)).collect()}
    none = spark.createDataFrame([], "document_id long, original string")
    assert {(r.correction_id, r.original_data) for r in O.correction_chain(rows, none).collect()} == want


def test_no_task_sees_the_whole_hot_key(spark):
    plan = O.number_corrections(hot_rows(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(document_id" in plan and "__bucket" in plan
    # The only window keyed by the document alone runs over per-bucket sums.
    alone = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window") and "__bucket" not in line.split("windowspecdefinition(")[1].split("ASC")[0]]
    assert all("__t" in line for line in alone)


def test_exact_percentiles(spark):
    values = [float(i % 97) / 4 for i in range(2000)] + [3.25] * 1500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.share: r.value for r in A.exact_percentiles(df, "v", [0.0, 0.5, 0.95, 0.99, 1.0]).collect()}
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in got])).alias("p")).first().p
    assert list(got.values()) == want


def test_running_sum_without_keys(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v"), F.lit(2).alias("n"))
    out = skew.running_sum(df, [], ["v"], F.floor(F.col("v") / 10), "upto", F.col("n")).collect()
    assert {(r.v, r.upto) for r in out} == {(v, 2 * (v + 1)) for v in range(100)}


def test_latest_by_takes_the_newest_whole_row(spark):
    rows = hot_rows(spark)
    newest = {r.document_id: r.correction_id for r in O.latest_by(rows, ["document_id"], ["ts", "correction_id"]).collect()}
    best = {}
    for r in rows.collect():
        best[r.document_id] = max(best.get(r.document_id, (r.ts, r.correction_id)), (r.ts, r.correction_id))
    assert newest == {k: v[1] for k, v in best.items()}


def test_an_outlier_leaves_percentiles_balanced(spark):
    """Only values around the wanted ranks are counted one by one, wherever the extremes lie."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    df = df.union(spark.createDataFrame([(1e15,)], "v double"))
    values = sorted(r["v"] for r in df.collect())
    for shares in ([0.5, 0.95, 0.99], [0.0, 1.0], [0.5, 0.50001]):
        got = {r["share"]: r["value"] for r in A.exact_percentiles(df, "v", shares).collect()}
        for s in shares:
            at = s * (len(values) - 1)
            lo, hi = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert abs(got[s] - (lo + (hi - lo) * (at - int(at)))) < 1e-6
    metrics = A.exact_percentiles(df, "v", [0.5, 0.95, 0.99])
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert plan.count("percentile_approx(v") and "CartesianProduct" not in plan


def test_few_rows_and_ties(spark):
    for n in (1, 2, 3, 7, 40):
        values = sorted(i // 3 * 1.5 for i in range(n))
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = {r["share"]: r["value"] for r in A.exact_percentiles(df, "v", [0.25, 0.5, 0.95, 0.99]).collect()}
        for s, v in got.items():
            at = s * (n - 1)
            assert abs(v - (values[int(at)] + (values[min(int(at) + 1, n - 1)] - values[int(at)]) * (at - int(at)))) < 1e-9


def test_first_rows_and_total_in_one_scan(spark, tmp_path):
    from paperloom.operators.ordering import first_with_total

    df = spark.range(1000).select(F.when(F.col("id") % 100 > 1, F.col("id")).alias("id"), F.array(F.lit("x")).alias("a")).repartition(7)
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    out = first_with_total(stored, "id", 25, "n")
    assert [r["id"] for r in out.collect()] == [None] * 20 + [2, 3, 4, 5, 6] and {r["n"] for r in out.collect()} == {1000}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert first_with_total(stored.where("false"), "id", 5, "n").count() == 0
    assert first_with_total(df, "id", 0, "n").count() == 0
