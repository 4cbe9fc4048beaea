"""Corpus statistics and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def mean_of(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.agg(F.avg(value.cast("double")).alias(name))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed, empty ones kept.

    One pass finds both ends, the other counts bins; what is shuffled is one row for each task and bin.
    """
    values = df.select(value.cast("double").alias("_x")).filter("_x is not null")
    # One row of two numbers; a single distinct value still gets a range one wide around it.
    lo, hi = values.agg(F.min("_x"), F.max("_x")).first()
    if lo is None:
        lo, hi = 0.0, 1.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = F.least(F.floor((F.col("_x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    filled = values.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(filled, "bin", "left")
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        )
    )


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(label).distinct().orderBy(label)


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight of each class present: rows / (classes * rows of the class)."""
    counts = label_counts(df, label)
    # The window runs over the counts, one row per class of the label domain.
    every = W.partitionBy()
    weight = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    return counts.select(label, "n", weight.cast("double").alias("weight"))


def smallest_group(df: DataFrame, label: str = "label") -> DataFrame:
    return label_counts(df, label).agg(F.min("n").alias("n"))


def weights_complete(df: DataFrame, n_labels: int, label: str = "label") -> DataFrame:
    """Do the rows cover all ``n_labels`` classes, and which ones are missing."""
    present = df.select(label).distinct()
    domain = df.sparkSession.range(n_labels).select(F.col("id").cast("int").alias(label))
    return (
        domain.join(present.withColumn("_here", F.lit(1)), label, "left")
        .agg(
            F.count("_here").alias("n_present"),
            F.array_join(F.sort_array(F.collect_list(F.when(F.col("_here").isNull(), F.col(label)))), ",").alias(
                "missing"
            ),
        )
        .select("n_present", "missing", (F.col("n_present") == n_labels).cast("int").alias("complete"))
    )
