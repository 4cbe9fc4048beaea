"""Train / score jobs: prediction tables flow into the metrics; models can be saved and used again."""

from taleweave.operators import jobs
from taleweave.operators.splits import split3
from taleweave.plans import fixtures as fx
from taleweave.plans.model_queries import split_stories
import __spark_entry__ as entry


def test_category_model_round_trip(spark, sf, tmp_path):
    model, predictions = jobs.category(split_stories(spark, sf))
    first = {r.row_id: r.pred for r in predictions.collect()}
    jobs.save_model(model, f"{tmp_path}/model")
    again = jobs.load_model(f"{tmp_path}/model")
    held = jobs.story_input(split_stories(spark, sf)).filter("split <> 'train'")
    assert {r.row_id: r.pred for r in jobs.score_classes(again, held, "row_id", ["split"]).collect()} == first
    report = {r.split: r for r in jobs.class_split_report(predictions).collect()}
    assert set(report) == {"test", "validation"}
    assert sum(r.samples for r in report.values()) == len(first)


def test_class_model_learns_a_word(spark):
    from pyspark.sql import functions as F

    rows = spark.range(400).select(
        F.col("id").alias("story_id"),
        *[F.lit("same text here").alias(c) for c in fx.STORY_COLUMNS[:4]],
        F.when(F.col("id") % 2 == 0, "sunny day").otherwise("rainy night").alias("fifth_sentence"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    _, predictions = jobs.category(split3(rows, "story_id"))
    assert predictions.filter("pred <> label").count() == 0


def test_joint_report_has_both_parts(spark, sf):
    row = entry.queries()["mlj_joint_report"](spark, sf).collect()
    assert {r.split for r in row} <= {"test", "validation"} and all(r.perplexity > 1 and 0 <= r.accuracy <= 1 for r in row)


def test_generated_report(spark, sf):
    row = entry.queries()["txt_generated_report"](spark, sf).first()
    assert row.bleu >= 0 and 0 <= row.rouge <= 1 and 0 <= row.meteor <= 1
