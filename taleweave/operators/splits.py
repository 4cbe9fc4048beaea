"""Seeded splits, balanced samples and limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from taleweave.operators.ranking import first_per_group, row_index, seeded_hash, within_first
from taleweave.session import hand_over

DEFAULT_SEED = 690


def split2(
    df: DataFrame,
    key: str,
    fraction: float = 0.1,
    seed: int | str = DEFAULT_SEED,
    held_name: str = "test",
    rest_name: str = "train",
) -> DataFrame:
    """Two-way split: ``ceil(fraction * n)`` rows are held out, the rest is train. Only keys are read to find the cut."""
    keys = hand_over(df.select(key), "split-keys")
    held = within_first(keys, key, seed, F.ceil(F.lit(fraction) * F.col("_total")))
    return df.withColumn("split", F.when(held, F.lit(held_name)).otherwise(F.lit(rest_name)))


def split3(
    df: DataFrame,
    key: str,
    held_fraction: float = 0.2,
    test_fraction: float = 0.5,
    seed: int | str = DEFAULT_SEED,
) -> DataFrame:
    """80/10/10: hold out a part, then halve it; the first half is test, the remainder validation.

    The keys are put at rest once and both cuts are found among them, so ``df`` is read once before the result is.
    """
    keys = hand_over(df.select(key), "split-keys")
    held = within_first(keys, key, seed, F.ceil(F.lit(held_fraction) * F.col("_total")))
    test = within_first(keys.filter(held), key, f"{seed}-held", F.ceil(F.lit(test_fraction) * F.col("_total")))
    return df.withColumn(
        "split", F.when(~held, F.lit("train")).when(test, F.lit("test")).otherwise(F.lit("validation"))
    )


def split_external(
    df: DataFrame, test: DataFrame, key: str, fraction: float = 0.1, seed: int | str = DEFAULT_SEED
) -> DataFrame:
    """Train/validation from one table, test from another one of the same columns."""
    inside = split2(df, key, fraction, seed, held_name="validation")
    return inside.unionByName(test.withColumn("split", F.lit("test")))


def split_views(df: DataFrame) -> Mapping[str, DataFrame]:
    """The three named splits as filters over one table."""
    return {
        name: df.filter(F.col("split") == name).drop("split") for name in ("train", "validation", "test")
    }


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _enough(df: DataFrame, available: Column, n: int) -> DataFrame:
    ok = F.when(available >= n, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"fewer than {n} rows to select")).cast("boolean")
    )
    return df.filter(ok)


def first_n(df: DataFrame, key: str, n: int, strict: bool = True) -> DataFrame:
    """First ``n`` rows in order of the unique ``key``; asking for more rows than there are is an error when ``strict``.

    Only keys are ranked, whatever ``n`` is; rows are then compared with the key at the cut.
    """
    index = hand_over(row_index(df.select(key), key, "_i"), "row-index")
    cut = index.filter(F.col("_i") == n - 1).first()
    head = (df if cut is None else df.filter(F.col(key) <= F.lit(cut[0]))) if n > 0 else df.limit(0)
    return _enough(head, F.lit(index.count()), n).sort(key) if strict else head.sort(key)


def first_n_per_split(df: DataFrame, key: str, limits: Mapping[str, int], strict: bool = True) -> DataFrame:
    """A separate row limit for each named split, from one ranking of the keys inside the splits."""
    keys = df.select("split", key).filter(F.col("split").isin(*limits))
    index = hand_over(row_index(keys, key, "_i", within="split"), "row-index")
    limit = F.coalesce(*[F.when(F.col("split") == s, F.lit(n)) for s, n in limits.items()])
    head = df.join(index.filter(F.col("_i") < limit).select(key), key, "left_semi")
    if strict:
        there = {r["split"]: r["n"] for r in split_counts(index).collect()}  # one row for each named split
        for name, n in limits.items():
            head = _enough(head, F.lit(there.get(name, 0)), n)
    return head


def random_rows(df: DataFrame, key: str, k: int = 3, seed: int | str = DEFAULT_SEED) -> DataFrame:
    """``k`` distinct rows picked at random (a top-k over the seeded hash)."""
    return df.orderBy(seeded_hash(F.col(key), seed), key).limit(k)


def balance_down(df: DataFrame, label: str, key: str, seed: int | str = DEFAULT_SEED) -> DataFrame:
    """Downsample every label to the size of the rarest one."""
    rows = hand_over(df.select(key, label), "labelled-keys")
    smallest = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    if smallest is None:
        return df
    kept = first_per_group(rows, [label], key, seed, F.lit(smallest))
    return df.join(kept.select(key), key, "left_semi") if set(df.columns) - {key, label} else kept


def effective_counts(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Reported number of samples per split: the limit or the split's size, whichever is smaller."""
    cap = F.coalesce(*[F.when(F.col("split") == s, F.lit(n)) for s, n in limits.items()], F.col("n"))
    return split_counts(df).select("split", F.least(cap, F.col("n")).cast("long").alias("samples"))
