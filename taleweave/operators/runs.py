"""Runs that go on where they ended: finished stages are kept in a folder and found again by what they were made from.

A stage's key is a hash of the run's input, its parameters and the stage's name. The stage's table or model is published
whole under that key, so a folder that is there is finished, a stage that was cut off is made again, and a run with other
data or parameters shares the folder without meeting.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from taleweave.sources.writers import publish


def fingerprint(*inputs: DataFrame) -> str:
    """Of the rows of the tables, in whatever order and partition they stand: one pass over each."""
    parts = []
    for df in inputs:
        row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(df.columns)])
        sums = df.select(row.alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.sum((F.col("h") % 1_000_003).cast("long") ** 2))
        parts.append((sorted(df.columns), [str(v) for v in sums.first()]))
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


class Run:
    """Stages below ``folder`` for one input and one set of parameters."""

    def __init__(self, spark: SparkSession, folder: str, source: str, **parameters: Any):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.base = json.dumps([source, parameters], sort_keys=True, default=str)

    def path(self, stage: str) -> str:
        key = hashlib.sha256(f"{self.base}/{stage}".encode()).hexdigest()[:24]
        return f"{self.folder}/{stage}-{key}"

    def finished(self, stage: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(stage))
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def table(self, stage: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, built unless it is finished."""
        if not self.finished(stage):
            publish(self.spark, self.path(stage), build().write.parquet)
        return self.spark.read.parquet(self.path(stage))

    def model(self, stage: str, fit: Callable[[], Any], save: Callable[[Any, str], None], load: Callable[[str], Any]) -> Any:
        """The stage's model, fitted unless it is finished; always the saved one, so both ways go on alike."""
        if not self.finished(stage):
            model = fit()
            publish(self.spark, self.path(stage), lambda path: save(model, path))
        return load(self.path(stage))
