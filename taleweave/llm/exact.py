"""Exact dedup by progressive refinement: equal length, then equal hash of the beginning, then equal hash of the whole.

The first pass counts lengths and hashes nothing. Beginnings are hashed only where another row has the same length, and a
whole text is hashed only where another row shares length and beginning; only there are rows told apart that repeat an id.
Texts are equal when they are identical after lower-casing A to Z, which leaves the length as it is.

A null text is an empty one. Of equal texts the row with the largest id stays; a row without an id stays only where none
has one. Where id and text are repeated, one of the rows stays and the others are dropped. An empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from taleweave.llm.common import as_bytes, slices, text_key, whole_text, without_rows
from taleweave.session import hand_over

#: Characters whose hash makes the second level.
PREFIX = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS = ["size", "prefix"]


@F.arrow_udf(StringType())
def sha256_lower(texts: pa.Array) -> pa.Array:
    """SHA-256 of the UTF-8 text with A to Z in lower case, as lowercase hex."""
    out = []
    for part in slices(texts):
        data, begin = as_bytes(part)
        data = data.tobytes().lower()
        out += [hashlib.sha256(data[a : b - 1]).hexdigest() for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return pa.array(out, pa.string())


def _size() -> Column:
    return F.octet_length(whole_text()).cast("long").alias("size")


def _beginning() -> Column:
    return F.substring(whole_text(), 1, PREFIX).alias("beginning")


def _hashed() -> Column:
    return F.xxhash64(F.translate("beginning", _UPPER, _LOWER))


def lengths(docs: DataFrame) -> DataFrame:
    """First level: lengths that several rows have."""
    return docs.select(_size()).groupBy("size").agg(F.count("*").alias("n")).filter("n > 1").select("size")


def _refined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows' first two levels; the levels that several rows share; and the verdict on the rows that share them."""
    shared = hand_over(lengths(docs), "lengths")
    # second level: hashes of beginnings, of rows whose length is shared; the others have none
    keys = docs.select("doc_id", _size(), _beginning()).join(shared.withColumn("met", F.lit(True)), "size", "left")
    keys = hand_over(keys.select("doc_id", "size", F.when(F.col("met"), _hashed()).alias("prefix")), "levels")
    pairs = keys.filter("prefix is not null").groupBy(*_LEVELS).agg(F.count("*").alias("n")).filter("n > 1")
    pairs = hand_over(pairs.select(*_LEVELS), "pairs")
    # third level: hashes of whole texts, of rows that share both
    texts = docs.select("doc_id", _size(), _beginning(), whole_text().alias("whole")).join(shared, "size", "left_semi")
    texts = texts.withColumn("prefix", _hashed()).join(pairs, _LEVELS, "left_semi")
    rows = texts.select("doc_id", text_key("whole").alias("row"), *_LEVELS, sha256_lower("whole").alias("full_hash"))
    rows = hand_over(rows, "full")
    group = [*_LEVELS, "full_hash"]
    sizes = rows.groupBy(*group).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    sizes = hand_over(sizes, "group-sizes")  # at rest, so that the join has nothing to sum and hot groups can be split
    rows = rows.join(sizes, group).withColumn("best", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    rows = hand_over(rows, "grouped")  # nothing that needs a group together follows, so a hot group's rows can be split
    # several rows can carry the id that stays: the first of them does
    turn = F.row_number().over(Window.partitionBy(*group, "doc_id").orderBy("row"))
    best = rows.filter("best").withColumn("kept", turn == 1)
    verdict = best.unionByName(rows.filter("not best").withColumn("kept", F.lit(False)))
    return keys, pairs, verdict.drop("best", *_LEVELS)


def exact_groups(docs: DataFrame, hash_all: bool = False) -> DataFrame:
    """Each row's group: doc_id, full_hash, keep_id, group_size and kept.

    ``full_hash`` is null where a row was told apart before its whole text was needed, unless ``hash_all`` is set: then
    one more pass hashes those texts.
    """
    keys, pairs, verdict = _refined(docs)
    if hash_all:
        all_rows = docs.select("doc_id", _size(), _beginning(), sha256_lower(whole_text()).alias("full_hash"))
        alone = all_rows.select("doc_id", "size", _hashed().alias("prefix"), "full_hash")
    else:
        alone = keys.withColumn("full_hash", F.lit(None).cast("string"))
    alone = alone.join(pairs, _LEVELS, "left_anti").select(
        "doc_id",
        "full_hash",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    return verdict.drop("row").unionByName(alone)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest id."""
    _, _, verdict = _refined(docs)
    named = hand_over(
        verdict.groupBy("doc_id", "row").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "verdict"
    )
    return without_rows(docs, named.filter("not kept"), named.filter("kept and n > 1"))
