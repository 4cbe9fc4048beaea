"""Metrics over several batches: what each batch adds is a small table, kept by the batch's id and summed when asked for.

A state is a folder with one table for each batch: (metric, part, value) rows that add up, such as matched n-grams of an
order, the sum of a row score, or how often a class was taken for another. A batch is published whole under its id, so
adding it again, in the same or another session, changes nothing, and batches may be added by several jobs at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taleweave.operators import textmetrics
from taleweave.operators.evaluate import safe_ratio
from taleweave.session import hand_over
from taleweave.sources.writers import publish

SCHEMA = "metric string, part string, value double"


def text_sums(df: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """What a batch of generated texts adds to bleu, rouge and meteor."""
    tokens = df.select(
        key,
        textmetrics.mt_tokens(F.col(candidate)).alias("mc"),
        textmetrics.mt_tokens(F.col(reference)).alias("mr"),
        textmetrics.overlap_tokens(F.col(candidate)).alias("oc"),
        textmetrics.overlap_tokens(F.col(reference)).alias("or"),
        textmetrics.lower_words(F.col(candidate)).alias("wc"),
        textmetrics.lower_words(F.col(reference)).alias("wr"),
    )
    orders = textmetrics.ngram_overlap(tokens, key, "mc", "mr")
    names = ("matches", "candidate_total", "reference_total")
    cells = [F.struct(F.concat_ws("-", F.lit(n), "order").alias("part"), F.col(n).cast("double").alias("value")) for n in names]
    bleu = orders.select(F.inline(F.array(*cells))).select(F.lit("bleu").alias("metric"), "part", "value")
    rouge = textmetrics.rouge_l_rows(tokens, key, "oc", "or").select(F.col("rouge_l").alias("v"))
    meteor = textmetrics.meteor_rows(tokens, key, "wc", "wr").select(F.col("meteor").alias("v"))
    return bleu.unionByName(_row_sums("rouge", rouge)).unionByName(_row_sums("meteor", meteor))


def _row_sums(metric: str, rows: DataFrame) -> DataFrame:
    sums = rows.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"), F.count("v").cast("double").alias("rows"))
    cells = [F.struct(F.lit(n).alias("part"), F.col(n).alias("value")) for n in ("sum", "rows")]
    return sums.select(F.inline(F.array(*cells))).select(F.lit(metric).alias("metric"), "part", "value")


def class_sums(predictions: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """What a batch of predictions adds: how often each class was taken for each."""
    counts = predictions.groupBy(F.concat_ws(">", F.col(label).cast("string"), F.col(pred).cast("string")).alias("part"))
    return counts.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("confusion").alias("metric"), "part", "value")


def _folder(path: str, batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError(f"batch id {batch!r} is no plain name")
    return f"{path.rstrip('/')}/batch={batch}"


def add(path: str, batch: str, sums: DataFrame) -> bool:
    """Add a batch's sums to the state at ``path``; false, and nothing changes, if the batch is there already."""
    spark = sums.sparkSession
    try:
        publish(spark, _folder(path, batch), sums.select("metric", "part", "value").coalesce(1).write.parquet)
    except FileExistsError:
        return False
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """(batch, metric, part, value) of a state."""
    return spark.read.schema(f"{SCHEMA}, batch string").parquet(path).select("batch", "metric", "part", "value")


def merge(spark: SparkSession, sources: list[str], target: str) -> None:
    """One state of several. A batch that is in more than one of them counts once."""
    whole = None
    for source in sources:
        rows = read(spark, source)
        whole = rows if whole is None else whole.unionByName(rows)
    whole = hand_over(whole.dropDuplicates(["batch", "metric", "part"]), "state")
    for row in whole.select("batch").distinct().collect():
        add(target, row["batch"], whole.filter(F.col("batch") == row["batch"]))


def totals(state: DataFrame) -> DataFrame:
    return state.groupBy("metric", "part").agg(F.sum("value").alias("value"))


def compute_texts(state: DataFrame) -> DataFrame:
    """One row of bleu, rouge and meteor over all batches, as if they were one."""
    sums = hand_over(totals(state), "totals")
    orders = sums.filter("metric = 'bleu'").select(F.split("part", "-").alias("p"), "value")
    names = ("matches", "candidate_total", "reference_total")

    def of(name: str) -> Column:
        return F.sum(F.when(F.get("p", F.lit(0)) == name, F.col("value"))).cast("long").alias(name)

    orders = orders.groupBy(F.get("p", F.lit(1)).cast("int").alias("order")).agg(*[of(n) for n in names])

    def mean(metric: str) -> Column:
        rows = sums.filter(F.col("metric") == metric)
        part = [F.sum(F.when(F.col("part") == n, F.col("value"))) for n in ("sum", "rows")]
        return rows.agg((part[0] / F.when(part[1] > 0, part[1])).alias("v")).scalar().alias(metric)

    return textmetrics.bleu_of(orders).select("bleu", mean("rouge"), mean("meteor"))


def confusion(state: DataFrame) -> DataFrame:
    """(label, pred, n) over all batches."""
    sums = totals(state).filter("metric = 'confusion'").select(F.split("part", ">").alias("p"), F.col("value").cast("long").alias("n"))
    return sums.select(F.get("p", F.lit(0)).cast("int").alias("label"), F.get("p", F.lit(1)).cast("int").alias("pred"), "n")


def accuracy(state: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    return confusion(state).agg(safe_ratio(right, F.sum("n")).alias("accuracy"), F.sum("n").alias("samples"))
