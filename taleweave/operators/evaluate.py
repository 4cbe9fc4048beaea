"""Classification, multi-label and regression metrics.

Every class metric is read off the (label, prediction) count table, so the rows are aggregated once and what moves
between tasks is at most classes x classes counts per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Ratio with 0 for an empty denominator."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.when(bottom != 0, bottom))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_table(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class of the truth or the predictions: hits, support and number predicted."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("c"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("pred").alias("c"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    return (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "c")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )


def weighted_scores(classes: DataFrame, by: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Precision, recall and F1 averaged by support; a zero denominator scores 0."""
    p = safe_ratio(F.col("tp"), F.col("predicted"))
    r = safe_ratio(F.col("tp"), F.col("support"))
    scored = classes.withColumns({"p": p, "r": r}).withColumn(
        "f", safe_ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    )

    def weighted(name: str) -> Column:
        return safe_ratio(F.sum(F.col("support") * F.col(name)), F.sum("support"))

    return scored.groupBy(*by).agg(
        *extra,
        weighted("p").alias("precision"),
        weighted("r").alias("recall"),
        weighted("f").alias("f1"),
    )


def classification_report(
    df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """accuracy, balanced accuracy, weighted precision / recall / F1 and the sample count, per group of ``by``."""
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    return weighted_scores(
        class_table(confusion(df, label, pred, by), by),
        by,
        extra=(
            safe_ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
            F.avg(recall).alias("balanced_accuracy"),
            F.sum("support").alias("samples"),
        ),
    )


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return classification_report(df, label, pred).select("accuracy")


def balanced_accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return classification_report(df, label, pred).select("balanced_accuracy")


def weighted_prf(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return classification_report(df, label, pred).select("precision", "recall", "f1")


def multilabel_report(
    df: DataFrame, n_labels: int, label: str = "label", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """Subset accuracy, Hamming loss and support-weighted scores of 0/1 vectors.

    The slots are a fixed few, so each gets its own sums in a single aggregation and no row is exploded.
    """
    sums: list[Column] = []
    for i in range(n_labels):
        y, z = F.get(F.col(label), F.lit(i)), F.get(F.col(pred), F.lit(i))
        sums += [
            F.sum((y * z).cast("long")).alias(f"tp{i}"),
            F.sum(y.cast("long")).alias(f"support{i}"),
            F.sum(z.cast("long")).alias(f"predicted{i}"),
            F.sum((y != z).cast("long")).alias(f"wrong{i}"),
        ]
    same = F.forall(F.arrays_zip(F.col(label).alias("y"), F.col(pred).alias("z")), lambda s: s["y"] == s["z"])
    one = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(same.cast("long")).alias("exact"), *sums
    )
    slots = F.array(
        *[
            F.struct(*[F.col(f"{m}{i}").alias(m) for m in ("tp", "support", "predicted", "wrong")])
            for i in range(n_labels)
        ]
    )
    classes = one.select(*by, "samples", "exact", F.inline(slots))
    return weighted_scores(
        classes,
        by,
        extra=(
            (F.max("exact") / F.max("samples")).alias("accuracy"),
            (F.sum("wrong") / (F.max("samples") * n_labels)).alias("hamming_loss"),
            F.max("samples").alias("samples"),
        ),
    )


def mean_squared_error(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    gap = F.col(pred) - F.col(label)
    return df.agg(F.avg(gap * gap).alias("mse"))


def elementwise_accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("float").cast("double")).alias("accuracy"))


def with_combined_score(report: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """With more than one metric, also their plain mean."""
    if len(metrics) < 2:
        return report
    summed = F.col(metrics[0])
    for name in metrics[1:]:
        summed = summed + F.col(name)
    return report.withColumn("combined_score", summed / len(metrics))
