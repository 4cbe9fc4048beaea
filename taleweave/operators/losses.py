"""Losses over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from taleweave.functions.arrays import bce_cell, nll


def cross_entropy(df: DataFrame, scores: str = "z", label: str = "label") -> DataFrame:
    return df.agg(F.avg(nll(F.col(scores), F.col(label))).alias("loss"))


def weighted_cross_entropy(
    df: DataFrame, weights: DataFrame, scores: str = "z", label: str = "label"
) -> DataFrame:
    """Class-weighted mean: sum(w * nll) / sum(w).

    Losses are summed per class before the weights are joined, so one row per class meets its weight and a hot class
    never travels.
    """
    per_class = df.groupBy(F.col(label).alias("label")).agg(
        F.sum(nll(F.col(scores), F.col(label))).alias("nll"), F.count(F.lit(1)).alias("n")
    )
    return per_class.join(weights.select("label", "weight"), "label").agg(
        (F.sum(F.col("weight") * F.col("nll")) / F.sum(F.col("weight") * F.col("n"))).alias("loss")
    )


def bce_with_logits(df: DataFrame, scores: str = "z", label: str = "label") -> DataFrame:
    """Mean over all rows and labels of the binary cross entropy of raw scores."""
    cells = F.zip_with(F.col(scores), F.col(label), bce_cell)
    per_row = df.select(
        F.aggregate(cells, F.lit(0.0), lambda a, x: a + x).alias("s"), F.size(cells).alias("k")
    )
    return per_row.agg((F.sum("s") / F.sum("k")).alias("loss"))


def mse_loss(df: DataFrame, pred: str = "prediction", label: str = "label") -> DataFrame:
    gap = F.col(pred) - F.col(label)
    return df.agg(F.avg(gap * gap).alias("loss"))


def next_token_nll(
    df: DataFrame, sequence: str, position: str, token: str, scores: str = "z", pad_token: int | None = None
) -> DataFrame:
    """Loss of the scores at each position against the token that follows.

    Padding counts, as in the joint task, unless ``pad_token`` names the token to leave out.
    """
    order = W.partitionBy(sequence).orderBy(position)
    shifted = df.select(sequence, position, scores, F.lead(token).over(order).alias("target")).filter(
        "target is not null"
    )
    if pad_token is not None:
        shifted = shifted.filter(F.col("target") != pad_token)
    return shifted.select(sequence, position, nll(F.col(scores), F.col("target")).alias("nll"))


def mean_loss(losses: DataFrame, value: str = "nll") -> DataFrame:
    return losses.agg(F.avg(value).alias("loss"), F.count(value).alias("n"))


def perplexity(losses: DataFrame, value: str = "nll") -> DataFrame:
    return losses.agg(F.exp(F.avg(value)).alias("perplexity"))


def joint(lm_loss: Column, cls_loss: Column) -> Column:
    """Sum of the losses there are; null when there is none."""
    both_missing = lm_loss.isNull() & cls_loss.isNull()
    return F.when(
        ~both_missing, F.coalesce(lm_loss, F.lit(0.0)) + F.coalesce(cls_loss, F.lit(0.0))
    )
