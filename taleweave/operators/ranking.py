"""Exact ranks and exact cuts without an unpartitioned window over rows.

Order is by ``md5(seed-key)`` where it must look random. The first hex digits of the hash give 65,536 near-equal
buckets whatever the keys look like, so one bounded count table tells which bucket a cut falls into, and only the rows
of that bucket are ever sorted. The data itself is not shuffled: each row is compared with the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from taleweave.session import cut_lineage, hand_over

PREFIX_DIGITS = 4


def seeded_hash(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def unit_interval(key: Column, seed: int | str) -> Column:
    """A reproducible uniform number in [0, 1) with 52 bits."""
    bits = F.conv(F.substring(seeded_hash(key, seed), 1, 13), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(1 << 52))


def _bucketed(df: DataFrame, key: str, seed: int | str, by: Sequence[str]) -> DataFrame:
    h = seeded_hash(F.col(key), seed)
    return df.select(
        *by, F.col(key).alias("_key"), h.alias("_h"), F.substring(h, 1, PREFIX_DIGITS).alias("_bucket")
    )


def _boundary_buckets(hashed: DataFrame, size: Column, by: Sequence[str]) -> DataFrame:
    """Per group: the hash bucket in which the first ``size`` rows end, and how many of its rows belong to them.

    ``size`` may use ``_total``, the number of rows of the group. Groups whose cut is empty have no row.
    """
    counts = hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*by)
    upto = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        counts.withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_through", F.sum("_n").over(upto))
        .withColumn("_need", F.least(size, F.col("_total")) - (F.col("_through") - F.col("_n")))
        .filter("_need >= 1 and _need <= _n")
        .select(*by, "_bucket", "_need")
    )


def within_first(df: DataFrame, key: str, seed: int | str, size: Column) -> Column:
    """Is the row among the first ``size`` rows of ``df`` in seeded hash order of its unique ``key``.

    The cut is found now and is a single (hash, key) value: one pass counts the hash buckets, and a second one reads
    only the bucket of the cut, a filter on the key that goes down to the scan. The returned condition compares with a
    constant, so rows are not shuffled and every later use of the split costs nothing more.
    """
    hashed = _bucketed(df, key, seed, ())
    bucket = _boundary_buckets(hashed, size, ()).first()
    if bucket is None:
        return F.lit(False)
    inside = hashed.filter(F.col("_bucket") == bucket["_bucket"])
    cut = inside.orderBy("_h", "_key").offset(int(bucket["_need"]) - 1).limit(1).first()
    h = seeded_hash(F.col(key), seed)
    return (h < cut["_h"]) | ((h == cut["_h"]) & (F.col(key) <= F.lit(cut["_key"])))


def _boundary(df: DataFrame, key: str, seed: int | str, size: Column, by: Sequence[str]) -> DataFrame:
    """Per group: the (hash, key) of the last row among the first ``size`` rows."""
    hashed = _bucketed(df, key, seed, by)
    need = _boundary_buckets(hashed, size, by)
    ranked = hashed.join(need, [*by, "_bucket"]).withColumn(
        "_rank", F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_h", "_key"))
    )
    return ranked.filter("_rank = _need").select(*by, F.struct("_h", "_key").alias("_cut"))


def first_per_group(df: DataFrame, by: Sequence[str], key: str, seed: int | str, size: Column) -> DataFrame:
    """The first ``size`` rows of every group in seeded hash order, however uneven the groups are.

    A hot group is spread over the hash buckets; nothing groups its rows in one task.
    """
    # One row per group, at rest so that Spark plans the join on its real size.
    cuts = hand_over(_boundary(df, key, seed, size, by), "cuts")
    here = F.struct(seeded_hash(F.col(key), seed).alias("_h"), F.col(key).alias("_key"))
    return df.join(cuts, list(by)).filter(here <= F.col("_cut")).drop("_cut")


def row_index(
    df: DataFrame, key: str | Sequence[str], name: str = "row_index", within: str | None = None
) -> DataFrame:
    """Running index from zero in ascending order of ``key`` (one column or several), restarting for each ``within``.

    A range sort spreads the rows evenly even when key values are bunched. The sorted rows are checkpointed, because
    sampled range bounds may differ if a lost partition were computed again, and each partition is then offset by the
    sizes of the ones before it.
    """
    groups = [] if within is None else [within]
    keys = [key] if isinstance(key, str) else list(key)
    ordered = cut_lineage(df.sort(*groups, *keys).withColumn("_mid", F.monotonically_increasing_id()))
    placed = ordered.withColumns(
        {"_part": F.shiftright("_mid", 33), "_at": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    sizes = placed.groupBy(*groups, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *groups, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    if within is None:
        # One row per sorted partition: as small as the partition count.
        offsets = F.broadcast(offsets)
    return (
        placed.join(offsets, [*groups, "_part"])
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_mid", "_part", "_at", "_shift")
    )
