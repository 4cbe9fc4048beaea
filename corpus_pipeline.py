"""From raw documents to packed training sequences, one operator of ``taleweave.llm`` a stage.

Every stage takes the rows that its predecessor kept and, but for the last, returns them with the columns of
``documents``: what the quality classifier rejects goes, then all but one of equal texts, then all but one of each group
of near copies; the rest is replicated to the sources' target weights and packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taleweave.llm.common import table
from taleweave.llm.exact import exact_dedup
from taleweave.llm.mixing import mix
from taleweave.llm.packing import pack
from taleweave.llm.quality import THRESHOLD, quality_score, train_quality
from taleweave.llm.simhash import near_dedup
from taleweave.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows of the table ``documents``."""
    model = train_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(quality_score(model) >= THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints (four-word shingles) are linked at four bits or fewer."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target asks for, in random order."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 token ids."""
    return pack(docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]

#: Field scores, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k:
            path = scratch_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs
