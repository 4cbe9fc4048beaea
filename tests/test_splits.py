"""Splits, cuts and ranks: sizes, disjointness, determinism, and behaviour under skew."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from taleweave.operators import splits
from taleweave.operators.ranking import first_per_group, row_index, within_first


def md5(seed, key):
    return hashlib.md5(f"{seed}-{key}".encode()).hexdigest()


def order(keys, seed):
    return sorted(keys, key=lambda k: (md5(seed, k), k))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 1871])
def test_split2_sizes_and_members(spark, n):
    rows = splits.split2(spark.range(n), "id").collect()
    held = {r.id for r in rows if r.split == "test"}
    assert len(rows) == n
    assert held == set(order(range(n), 690)[: math.ceil(0.1 * n)])


def test_split2_reference_sizes(spark):
    counts = {r.split: r.n for r in splits.split_counts(splits.split2(spark.range(1871), "id")).collect()}
    assert counts == {"test": 188, "train": 1683}


def test_split3_sizes_disjoint_and_stable(spark):
    n = 1871
    once = {r.id: r.split for r in splits.split3(spark.range(n), "id").collect()}
    again = {r.id: r.split for r in splits.split3(spark.range(n).repartition(13), "id").collect()}
    assert once == again and len(once) == n
    held = math.ceil(0.2 * n)
    test = math.ceil(0.5 * held)
    sizes = {s: sum(v == s for v in once.values()) for s in ("train", "test", "validation")}
    assert sizes == {"train": n - held, "test": test, "validation": held - test}


def test_split_of_string_keys(spark):
    df = spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"))
    held = {r.k for r in splits.split2(df, "k", 0.3).filter("split = 'test'").collect()}
    assert held == set(order([f"k{i}" for i in range(50)], 690)[:15])


def test_split_external_keeps_all_rows(spark):
    out = splits.split_external(spark.range(20), spark.range(100, 107), "id")
    assert {r.split: r.n for r in splits.split_counts(out).collect()} == {"validation": 2, "train": 18, "test": 7}


def test_balance_down_with_one_hot_label(spark):
    df = spark.range(3000).withColumn("label", F.when(F.col("id") % 100 == 0, 1).when(F.col("id") % 50 == 7, 2).otherwise(0))
    rows = splits.balance_down(df, "label", "id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.label, set()).add(r.id)
    assert {k: len(v) for k, v in by.items()} == {0: 30, 1: 30, 2: 30}
    hot = [i for i in range(3000) if i % 100 != 0 and i % 50 != 7]
    assert by[0] == set(order(hot, 690)[:30])


def test_first_per_group_with_size_beyond_group(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 3)
    assert first_per_group(df, ["g"], "id", 1, F.lit(100)).count() == 10


def test_within_first_zero(spark):
    assert spark.range(5).filter(within_first(spark.range(5), "id", 1, F.lit(0))).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_row_index_on_bunched_keys(spark, parts):
    keys = [10**12] + [i for i in range(500)] + [-5]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(parts)
    got = {r.k: r.row_index for r in row_index(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_row_index_restarts_in_each_group(spark):
    df = spark.range(400).withColumn("g", F.when(F.col("id") % 10 == 0, "b").otherwise("a"))
    got = {(r.g, r.id): r.row_index for r in row_index(df, "id", within="g").collect()}
    for g, members in (("b", range(0, 400, 10)), ("a", [i for i in range(400) if i % 10])):
        assert [got[(g, i)] for i in members] == list(range(len(members)))


def test_first_n_is_ordered_and_strict(spark):
    assert [r.id for r in splits.first_n(spark.range(50).repartition(7), "id", 4).collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="fewer than 60"):
        splits.first_n(spark.range(50), "id", 60).collect()
    assert splits.first_n(spark.range(50), "id", 60, strict=False).count() == 50


def test_first_n_of_any_size_goes_through_the_index(spark):
    assert sorted(r.id for r in splits.first_n(spark.range(50), "id", 7).collect()) == list(range(7))


def test_random_rows_are_distinct_and_seeded(spark):
    rows = [r.id for r in splits.random_rows(spark.range(40), "id", 3).collect()]
    assert rows == order(range(40), 690)[:3]


def test_split_views_and_effective_counts(spark):
    marked = splits.split3(spark.range(100), "id")
    views = splits.split_views(marked)
    assert {k: v.count() for k, v in views.items()} == {"train": 80, "validation": 10, "test": 10}
    got = {r.split: r.samples for r in splits.effective_counts(marked, {"train": 30, "test": 999}).collect()}
    assert got == {"train": 30, "validation": 10, "test": 10}
