"""Files in and out, model stages, and plan shapes."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import columns as C
from paperloom.operators import evaluate as E
from paperloom.operators import ordering as O
from paperloom.operators import projections as P
from paperloom.operators import stages as M
from paperloom.plans import views as V
from paperloom.sources import configs as SC
from paperloom.sources import documents as SD
from paperloom.sources import evalio as SE


def test_config_folders(spark, tmp_path):
    for name, prompt, schema in (("full", " Read it all. \n", '{"a": ""}'), ("bare", None, None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "notes.md").write_text("x")
        if prompt:
            (tmp_path / name / "system_prompt.txt").write_text(prompt)
            (tmp_path / name / "output_schema.json").write_text(schema)
    got = {r.dataset: (r.model_prompt, r.example_schema, r.max_pages_per_chunk) for r in SC.read_dataset_configs(spark, str(tmp_path)).collect()}
    assert got == {"full": ("Read it all.", '{"a": ""}', 10), "bare": ("Default model prompt.", "{}", 10)}
    table = tmp_path.parent / "config_table"
    assert SC.refresh_dataset_configs(spark, str(tmp_path), str(table)).count() == 2


def test_blob_listing(spark, tmp_path):
    for f in ("ds/a.pdf", "ds/sub/b.PNG", "other/c"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"12345")
    pages = spark.createDataFrame([("ds/a.pdf", 3), ("ds/sub/b.PNG", 9)], "blob_name string, num_pages int")
    got = {r.blob_name: (r.blob_size, r.extension, r.num_pages) for r in SD.read_blobs(spark, str(tmp_path), pages=pages).collect()}
    assert got == {"ds/a.pdf": (5, "pdf", 3), "ds/sub/b.PNG": (5, "png", None), "other/c": (5, "", None)}
    assert {r.blob_name for r in SD.read_blobs(spark, str(tmp_path), "ds").collect()} == {"ds/a.pdf", "ds/sub/b.PNG"}
    listing = SD.read_blobs(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing.split("ReadSchema")[-1]


def test_documents_round_trip(spark, sf, tmp_path):
    docs = V.documents(spark, sf)
    SD.write_documents(docs, str(tmp_path / "d"))
    back = SD.read_documents(spark, str(tmp_path / "d"))
    assert back.count() == docs.count()
    one = SD.read_documents(spark, str(tmp_path / "d"), "src1")
    plan = one.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "ocr_output" not in plan
    for kind in ("extraction", "evaluation", "summary"):
        SD.export_result(docs, str(tmp_path / kind), kind)
    texts = spark.read.text(str(tmp_path / "summary"), wholetext=True)
    assert texts.filter(F.startswith("value", F.lit("# "))).count() == texts.count() > 0


def test_eval_lines_keep_number_spelling(spark, tmp_path):
    def side(text):
        return spark.createDataFrame([("i1", text)], "item string, data string")

    lines = SE.eval_lines(side('{"n":\n 5.00}'), side('{"n": "5.0"}'), side("not json"))
    SE.write_eval_jsonl(lines, str(tmp_path / "e"))
    back = SE.read_eval_jsonl(spark, str(tmp_path / "e")).withColumn("item", F.lit(1))
    assert [(r.path, r.score) for r in E.evaluate_json(back, ["item"], [E.EXACT]).collect()] == [("n", 1.0)]


def test_run_files(spark, tmp_path):
    prefix = "json_evaluator.CustomStringEvaluator."
    for name, value in (("b.json", 0.5), ("a.json", 1.0), ("c.json", None)):
        metrics = {prefix + "x": value, "json_evaluator.Other.x": 7.0}
        (tmp_path / name).write_text(json.dumps({"rows": [], "metrics": {k: v for k, v in metrics.items() if v is not None}, "studio_url": None}, indent=2))
    runs = SE.read_eval_runs(spark, str(tmp_path))
    assert {(r.file, r.run_number) for r in runs.collect()} == {("a.json", 1), ("b.json", 2), ("c.json", 3)}
    assert [(r.field, r.average) for r in E.field_average(runs).collect()] == [("x", 0.8)]


def test_failing_calls_become_rows(spark):
    work = spark.range(10).select("id", F.when(F.col("id") % 2 == 0, "ok").otherwise("no").alias("payload"))

    def call(text):
        if text == "no":
            raise RuntimeError("limit")
        return text + "!"

    rows = M.run_stage(work, call, 2).collect()
    assert {(r.output, r.error) for r in rows} == {("ok!", None), (None, "RuntimeError: limit")}
    assert len(rows) == 10 and all(r.seconds >= 0 for r in rows)
    with pytest.raises(ValueError, match="unknown provider"):
        M.provider("nobody")
    with pytest.raises(ValueError, match="unknown evaluators"):
        E.evaluators("nobody")


def test_name_fallbacks(spark):
    rows = [
        ("ds__a__b.pdf", None, None, None), ("ds/x/y", None, "", "f"), ("plain", "d/f.pdf", "unknown", None),
        ("plain", None, None, "kept"), ("id", None, "d", "f"), ("__f", "q/r", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, blob_name string, dataset string, file_name string")
    cols = [F.col(c) for c in ("id", "blob_name", "dataset", "file_name")]
    got = [tuple(r.n) for r in df.select(C.dataset_and_file(*cols).alias("n")).collect()]
    assert got == [("ds", "a__b.pdf"), ("ds", "x/y"), ("d", "f.pdf"), ("unknown", "plain"), ("d", "f"), ("q", "r")]
    skipped = C.dataset_and_file(F.lit("i"), F.lit("c/ds/a/b.pdf"), *[F.lit(None).cast("string")] * 2, skip_container=True)
    assert tuple(df.select(skipped.alias("n")).first().n) == ("c", "a/b.pdf")


def test_legacy_fields_win_over_nested_ones(spark):
    df = spark.createDataFrame(
        [("x/y.pdf", "", "n.pdf", 0.0, 2.5, "err")],
        "id string, file_name string, filename string, processing_time double, t double, errors string",
    ).withColumn("properties", F.struct(F.col("t").alias("total_time_seconds"))).drop("t")
    row = P.normalize_document(df.withColumn("errors", F.array("errors"))).first()
    assert (row.filename, row.processing_time, row.dataset, row.status) == ("n.pdf", 2.5, "default-dataset", "failed")


def test_durations_and_sizes(spark):
    cases = [(None, 0), (0.5, 512), (12.34, 1536), (59.96, 1024), (75.0, 1048576), (3725.0, 5 * 1024**3)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, p struct<s:double,b:bigint>")
    got = [tuple(r)[1:] for r in df.select("i", C.format_duration(F.col("p.s")), C.format_bytes(F.col("p.b"))).orderBy("i").collect()]
    assert got == [("N/A", "0 B"), ("500ms", "512 B"), ("12.3s", "1.5 KB"), ("60.0s", "1 KB"), ("1m 15s", "1 MB"), ("1h 2m", "5 GB")]


def test_point_lookup_reaches_the_scan(spark, sf, tmp_path):
    SD.write_documents(V.documents(spark, sf), str(tmp_path / "d"))
    docs = SD.read_documents(spark, str(tmp_path / "d"))
    plan = O.get_documents(docs, ["src1__doc_1.pdf"]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,src1__doc_1.pdf)" in plan


def test_evaluation_needs_no_shuffle(spark, sf):
    plan = E.evaluate_json(V.eval_items(spark, sf), ["item"], max_depth=2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
