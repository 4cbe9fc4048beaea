"""Readers: delimited text, CSV, columnar data, split files, prediction files, in-memory columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from taleweave.functions.text import UNICODE_SPACE
from taleweave.sources.schemas import CLOZE_CSV, STORY_COLUMNS

# Field separator, prediction header, and the "prediction / label" pattern (names have no digits; blanks are
# spelled out, as regex engines differ on which characters beyond ASCII are white space).
FIELD_SEPARATOR = " | "
PREDICTION_HEADER = "index\tprediction"
PREDICTION_PATTERN = rf"([a-z_A-Z]+){UNICODE_SPACE}/{UNICODE_SPACE}([a-z_A-Z]+)"


def delimited_fields(line: Column) -> Column:
    return F.split(line, r" \| ", -1)


def read_delimited(
    spark: SparkSession, path: str, n_fields: int = 7, bad: str = "fail"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Story lines of id, five sentences and label.

    A wrong field count fails the job, or with ``bad='quarantine'`` the pair (good rows, bad lines) is returned.
    """
    fields = spark.read.text(path).select("value", delimited_fields(F.col("value")).alias("f"))
    right = F.size("f") == n_fields
    names = ["story_id", *STORY_COLUMNS, "label"]
    if len(names) != n_fields:
        names = [f"field{i}" for i in range(n_fields)]
    columns = [F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)]
    if bad == "quarantine":
        return fields.filter(right).select(*columns), fields.filter(~right).select("value")
    message = F.concat(F.lit(f"expected {n_fields} fields: "), F.col("value"))
    checked = F.when(right, F.col("f")).otherwise(F.raise_error(message).cast("array<string>"))
    return fields.select(checked.alias("f")).select(*columns)


def multihot(index_list: Column, slots: int = 4) -> Column:
    """``'0,2'`` -> ``[1,0,1,0]``."""
    chosen = F.transform(F.split(index_list, ",", -1), lambda i: F.trim(i).try_cast("int"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(slots - 1)),
        lambda i: F.when(F.array_contains(chosen, i), F.lit(1)).otherwise(F.lit(0)).cast("long"),
    )


def multihot_bad(index_list: Column, slots: int = 4) -> Column:
    """True when an index is missing, not a number, negative or too large."""
    chosen = F.transform(F.split(index_list, ",", -1), lambda i: F.trim(i).try_cast("int"))
    return F.exists(chosen, lambda i: i.isNull() | (i < 0) | (i >= slots))


def read_cloze_csv(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Header CSV of cloze stories, quoted fields may hold commas, quotes and newlines.

    A file with line ends inside fields cannot be split and is one task's work; without them set ``multi_line`` off.
    """
    return (
        spark.read.schema(CLOZE_CSV)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_columnar(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A saved dataset; ``split`` prunes to one split directory."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def read_split_files(
    spark: SparkSession, files: Mapping[str, str], schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """Train / validation / (test) files of one kind, csv or json, as one table with a ``split`` column.

    ``multi_line`` is for csv fields that hold line ends; without it csv files are split among tasks.
    """
    kinds = {name: path.rstrip("/").rsplit(".", 1)[-1] for name, path in files.items()}
    for name in ("train", "validation"):
        if name not in files:
            raise ValueError(f"need a {name} file")
    if kinds["train"] not in ("csv", "json"):
        raise ValueError("train file should be csv or json")
    for name, kind in kinds.items():
        if kind != kinds["train"]:
            raise ValueError(f"{name} file should have the extension of the train file")
    reader = spark.read.schema(schema)
    if kinds["train"] == "csv":
        reader = (
            reader.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multi_line)
        )
    parts = [
        reader.format(kinds[name]).load(path).withColumn("split", F.lit(name)) for name, path in files.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def read_prediction_lines(spark: SparkSession, path: str, pattern: str = PREDICTION_PATTERN) -> DataFrame:
    """(prediction, label) names of a prediction file; the header line and lines without a match are skipped.

    The header is known by its text: a file's first line is no longer known once its parts are read by several tasks.
    """
    return parse_prediction_lines(spark.read.text(path), pattern)


def parse_prediction_lines(lines: DataFrame, pattern: str = PREDICTION_PATTERN) -> DataFrame:
    return (
        lines.filter((F.col("value") != PREDICTION_HEADER) & F.col("value").rlike(pattern))
        .select(
            F.regexp_extract("value", pattern, 1).alias("prediction"),
            F.regexp_extract("value", pattern, 2).alias("label"),
        )
    )


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence[Any]], schema: T.StructType) -> DataFrame:
    """A table from equally long column lists, or from a pandas frame, that the caller already holds."""
    sizes = {len(v) for v in columns.values()} if isinstance(columns, dict) else {len(columns)}
    if len(sizes) > 1:
        raise ValueError("columns differ in length")
    if isinstance(columns, dict):
        rows = list(zip(*(columns[f.name] for f in schema.fields)))
        return spark.createDataFrame(rows, schema)
    return spark.createDataFrame(columns[[f.name for f in schema.fields]], schema)
