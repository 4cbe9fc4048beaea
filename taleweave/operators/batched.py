"""The batched-map surface: a function over column batches that may change the number of rows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taleweave.session import hand_over


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Apply ``fn`` to Arrow batches of the chosen columns; use column expressions wherever they exist."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    source = df if columns is None else df.select(*columns)
    return source.mapInPandas(run, schema)


#: Rows of one group that a call of a group function may see.
GROUP_ROWS = 100_000


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pa.Table], pa.Table],
    partial_schema: str,
    merge: Callable[[pa.Table], pa.Table],
    schema: str,
    spread: Sequence[str],
    most: int = GROUP_ROWS,
) -> DataFrame:
    """Apply ``partial`` to parts of each group and ``merge`` to the partial results of a group.

    A group of more than ``most`` rows is dealt into parts by a hash of the ``spread`` columns, so a group that holds most
    of the table is worked on by many tasks; ``merge`` sees one small table for each part. Both schemas begin with ``keys``.
    """
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = functools.reduce(lambda a, b: a & b, same)
    counts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    # only groups that are split are looked up; their number is bounded by rows / most
    counts = hand_over(counts.filter("_parts > 1"), "hot-groups")
    part = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)).alias("_part")
    dealt = df.join(counts, condition, "left").select(*df.columns, part)

    def one(rows: pa.Table) -> pa.Table:
        return partial(rows.drop_columns(["_part"]))

    parts = dealt.groupBy(*keys, "_part").applyInArrow(one, partial_schema)
    return parts.groupBy(*keys).applyInArrow(merge, schema)
