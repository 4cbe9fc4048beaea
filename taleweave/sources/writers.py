"""Writers. Every one is a distributed write into a directory; nothing is gathered on the driver.

A target is written beside its place and published by renaming once it is whole, so a write that fails leaves what was
there before, and a reader never sees half a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taleweave.functions.text import list_literal, names_where, one_line
from taleweave.sources.readers import PREDICTION_HEADER


def publish(spark: SparkSession, path: str, write: Callable[[str], None], overwrite: bool = False) -> None:
    """Have ``write`` fill a folder beside ``path`` and put it there by renaming.

    A target that is not empty is an error unless overwriting is asked for; then the old one goes when the new one is whole.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(target)
    if there and not overwrite and len(fs.listStatus(target)):
        raise FileExistsError(f"{path} already exists and is not empty")
    mark = uuid.uuid4().hex
    parent, name = target.getParent(), target.getName()
    # names that begin with an underscore are no data to a reader of the parent folder
    staged, old = (spark._jvm.org.apache.hadoop.fs.Path(parent, f"_{kind}-{name}-{mark}") for kind in ("staged", "old"))
    try:
        write(staged.toString())
        if there and not fs.rename(target, old):
            raise OSError(f"{path} can't be moved aside")
        if not fs.rename(staged, target):
            if there:
                fs.rename(old, target)
            raise OSError(f"{path} can't be published")
    finally:
        fs.delete(staged, True)
    if there:
        fs.delete(old, True)


def write_columnar(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet, one directory per split when there is a ``split`` column."""
    writer = df.write.partitionBy("split") if "split" in df.columns else df.write
    publish(df.sparkSession, path, writer.parquet, overwrite)


def label_name(label: Column, names: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), label)


def label_id(name: Column, names: Sequence[str]) -> Column:
    """Class id of a name, null for an unknown one."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(at > 0, at - 1).cast("int")


def single_label_line(index: Column, prediction: Column, label: Column, names: Sequence[str]) -> Column:
    return F.concat(
        index.cast("string"), F.lit(": "), label_name(prediction, names), F.lit(" / "), label_name(label, names)
    )


def multi_label_line(index: Column, prediction: Column, label: Column, names: Sequence[str]) -> Column:
    return F.concat(
        index.cast("string"),
        F.lit(": "),
        list_literal(names_where(prediction, names)),
        F.lit(" / "),
        list_literal(names_where(label, names)),
    )


def regression_line(index: Column, value: Column) -> Column:
    return F.concat(index.cast("string"), F.lit("\t"), F.format_string("%.3f", value.cast("double")))


def class_line(index: Column, prediction: Column, names: Sequence[str]) -> Column:
    """The two-column form: index, tab, class name."""
    return F.concat(index.cast("string"), F.lit("\t"), label_name(prediction, names))


def generated_line(index: Column, text: Column, reference: Column) -> Column:
    return F.concat(
        index.cast("string"), F.lit(": "), one_line(text), F.lit(" / "), one_line(reference)
    )


def write_lines(df: DataFrame, index: str, line: Column, path: str, overwrite: bool = False) -> None:
    """A header line, then one line per row in index order across the part files."""
    body = df.select(F.col(index).cast("long").alias("_i"), line.alias("value"))
    header = df.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("_i"), F.lit(PREDICTION_HEADER).alias("value")
    )
    publish(df.sparkSession, path, header.unionByName(body).sort("_i").select("value").write.text, overwrite)


def write_metrics(metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    """A one-row metrics table as JSON."""
    publish(metrics.sparkSession, path, metrics.write.json, overwrite)
