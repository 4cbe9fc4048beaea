"""Command-line runs from raw files to predictions and metrics."""

import pytest

from taleweave.__main__ import main
from taleweave.operators import workflows
from taleweave.plans import fixtures as fx
from taleweave.sources import readers
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    lines = fx.delimited_lines(spark, sf).filter(F.size(readers.delimited_fields(F.col("value"))) == 7)
    lines.write.text(f"{root}/category-raw")
    imp = fx.story_importance(spark, sf).select(
        F.concat_ws(" | ", F.col("story_id").cast("string"), *[F.regexp_replace(c, r"[|\r\n]+", " ") for c in fx.STORY_COLUMNS], "index_list").alias("value")
    )
    imp.write.text(f"{root}/importance-raw")
    main(["prepare", "category", f"{root}/category-raw", f"{root}/category"])
    main(["prepare", "importance", f"{root}/importance-raw", f"{root}/importance"])
    return root


def test_category_run_and_post_evaluation(spark, folder):
    main(["classify", "category", f"{folder}/category", f"{folder}/out", "--max-train-samples", "40"])
    report = {r.split: r for r in spark.read.json(f"{folder}/out/eval_results").collect()}
    again = workflows.post_evaluate(spark, f"{folder}/out/predict_results").first()
    assert again.samples == report["test"].samples and again.f1 == pytest.approx(report["test"].f1)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        main(["classify", "category", f"{folder}/category", f"{folder}/out"])


def test_importance_multitask(spark, folder):
    main(["multitask", "importance", f"{folder}/importance", f"{folder}/joint"])
    row = spark.read.json(f"{folder}/joint/eval_results").first()
    assert 0 <= row.hamming_loss <= 1 and row.perplexity > 1


def test_generate_run(spark, folder):
    data = readers.read_columnar(spark, f"{folder}/category")
    workflows.generate_endings(data, False, f"{folder}/gen", max_new_tokens=6)
    lines = [r.value for r in spark.read.text(f"{folder}/gen/predict_results").collect()]
    assert "index\tprediction" in lines and sum(" / " in v for v in lines) == len(lines) - 1
    assert spark.read.json(f"{folder}/gen/eval_results").count() == 2


def test_pair_regression_run(spark, sf, folder):
    fx.edit_pairs(spark, sf).write.parquet(f"{folder}/pairs")
    main(["regress", "pair", f"{folder}/pairs", f"{folder}/reg"])
    lines = [r.value for r in spark.read.text(f"{folder}/reg/test_results").collect()]
    assert all(v == "index\tprediction" or len(v.split("\t")[1].rsplit(".")[-1]) == 3 for v in lines)


def test_bad_importance_index_fails(spark, tmp_path):
    spark.createDataFrame([("s | a | b | c | d | e | 7",)], "value string").write.text(f"{tmp_path}/raw")
    with pytest.raises(Exception, match="bad sentence index list"):
        main(["prepare", "importance", f"{tmp_path}/raw", f"{tmp_path}/out"])


def test_single_text_runs_save_and_score(spark, sf, folder):
    fx.humor(spark, sf).write.parquet(f"{folder}/humor")
    main(["classify", "text", f"{folder}/humor", f"{folder}/text-out", "--save", f"{folder}/text-model", "--max-test-samples", "5"])
    main(["score", "text", f"{folder}/humor", f"{folder}/text-scored", "--model", f"{folder}/text-model"])
    lines = [r.value for r in spark.read.text(f"{folder}/text-scored/predict_results").collect()]
    assert len(lines) == 1 + fx.humor(spark, sf).count() and all(v.split("\t")[1] in "01" for v in lines[1:])
    main(["regress", "text", f"{folder}/humor", f"{folder}/text-reg", "--save", f"{folder}/reg-model"])
    assert {r.split for r in spark.read.json(f"{folder}/text-reg/eval_results").collect()} == {"test", "validation"}


def test_category_model_is_saved_and_used_again(spark, folder):
    main(["classify", "category", f"{folder}/category", f"{folder}/kept", "--save", f"{folder}/kept-model"])
    main(["score", "category", f"{folder}/category", f"{folder}/kept-scored", "--model", f"{folder}/kept-model"])
    n = readers.read_columnar(spark, f"{folder}/category").count()
    assert spark.read.text(f"{folder}/kept-scored/predict_results").count() == n + 1


def test_generation_settings(spark, folder):
    main(["generate", "story", f"{folder}/category", f"{folder}/gen2", "--top-k", "2", "--temperature", "0.5", "--max-new-tokens", "4"])
    assert spark.read.json(f"{folder}/gen2/eval_results_extra").count() == 1
