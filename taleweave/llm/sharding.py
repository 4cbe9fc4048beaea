"""Sharding by Karmarkar-Karp differencing: groups of equal texts go to shards whose bytes are near equal.

Differencing starts with one partial partition for each item, which holds the item in one part and nothing in the others,
and repeatedly combines the two whose parts are furthest apart, largest parts of one with smallest of the other.

It runs in two levels. Tasks difference the groups dealt to them by hash into a few bundles of near equal size, but hold
back single groups (the first by hash) to balance with at the end. All tasks' bundles and single groups, whose number
depends on the number of tasks only, and every group larger than a fixed share of a shard are then differenced into the
shards. A group of copies is counted before it is shuffled and moves as one row, whatever its size.

A null text is an empty one and weighs one byte. Rows that repeat an id are rows like any other. An empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from taleweave.llm.common import whole_text
from taleweave.session import hand_over

#: Bundles that all tasks together make at least, single groups that each task holds back.
BUNDLES, SINGLES = 1024, 64
#: A group is differenced among the bundles when it is larger than this share of a shard.
LARGE = 1 / 64
#: Rows of one shard are numbered in so many runs.
RUNS = 1024


def differencing(sizes: Sequence[int], parts: int) -> list[int]:
    """Part (0 to ``parts`` - 1) of every item; parts come in order of falling size."""
    if not sizes:
        return []
    # a partial partition: (-spread, tie, sums falling, for each sum the trees of its items); a tree is an item or a pair
    heap = [(-int(x), i, [int(x)] + [0] * (parts - 1), [i] + [None] * (parts - 1)) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        trees = [y if x is None else x if y is None else (x, y) for x, y in zip(ta, reversed(tb), strict=True)]
        order = sorted(range(parts), key=lambda k: -sums[k])
        low = sums[order[-1]]
        sums, trees = [sums[k] - low for k in order], [trees[k] for k in order]
        heapq.heappush(heap, (-sums[0], tie, sums, trees))
        tie += 1
    part = [0] * len(sizes)
    for k, tree in enumerate(heap[0][3]):
        stack = [] if tree is None else [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                part[node] = k
    return part


def _bundled(bundles: int, singles: int):
    """Deals the groups of each task to items: a single group each for the first by hash, bundles for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).sort_by("gid")
        task, weight = (rows.column(k).to_numpy() for k in ("task", "weight"))
        item = np.zeros(len(task), np.int32)
        for t in np.unique(task):
            own = np.flatnonzero(task == t)
            item[own[:singles]] = np.arange(min(singles, len(own)))
            rest = own[singles:]
            item[rest] = singles + np.array(differencing(weight[rest].tolist(), bundles), np.int32)
        columns = [rows.column("gid").combine_chunks(), pa.array(task), pa.array(item), pa.array(weight)]
        yield from pa.Table.from_arrays(columns, ["gid", "task", "item", "weight"]).to_batches(10_000)

    return run


def shards(docs: DataFrame, count: int = 16) -> DataFrame:
    """Each row's doc_id, size, text_crc32, shard and slot (its place in the shard, without gaps)."""
    spark = docs.sparkSession
    text = whole_text()
    rows = hand_over(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("gid"),
        ),
        "sizes",
    )
    groups = hand_over(rows.groupBy("gid").agg(F.sum("size").alias("weight")), "groups")
    # groups that fill a shard by themselves take one each; at most ``count`` can
    left, rest = count, int(groups.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    alone = []
    for r in groups.orderBy(F.desc("weight"), "gid").limit(count - 1).collect():
        if r.weight * left < rest:
            break
        alone.append(r.gid)
        left, rest = left - 1, rest - r.weight
    others = groups.filter(~F.col("gid").isin(alone)) if alone else groups
    bound = max(1, int(rest / left * LARGE))
    large = others.filter(F.col("weight") > bound)  # fewer than ``count`` / LARGE by what they weigh
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bundles = max(count, -(-BUNDLES // tasks))
    small = others.filter(F.col("weight") <= bound)
    small = small.withColumn("task", F.pmod(F.xxhash64("gid"), F.lit(tasks)).cast("int")).repartition(tasks, "task")
    items = hand_over(
        small.mapInArrow(_bundled(bundles, SINGLES), "gid string, task int, item int, weight long"), "items"
    )
    sums = items.groupBy("task", "item").agg(F.sum("weight").alias("weight"))
    single = large.select(F.lit(-1).alias("task"), F.row_number().over(Window.orderBy("gid")).alias("item"), "weight", "gid")
    single = single.select("gid", "task", "item", "weight")
    top = sums.unionByName(single.select("task", "item", "weight")).toArrow().sort_by([("task", "ascending"), ("item", "ascending")])
    part = differencing(top.column("weight").to_pylist(), left)
    table = pa.table({"task": top.column("task"), "item": top.column("item"), "shard": pa.array(part, pa.int32())})
    chosen = spark.createDataFrame(table)  # tasks x (bundles + singles) and the large groups: bounded
    named = items.drop("weight").unionByName(single.drop("weight")).join(F.broadcast(chosen), ["task", "item"])
    named = named.select("gid", "shard")
    if alone:
        own = pa.table({"gid": pa.array(alone, pa.string()), "shard": pa.array(range(left, left + len(alone)), pa.int32())})
        named = named.unionByName(spark.createDataFrame(own))
    placed = rows.join(named, "gid").select("doc_id", "size", "text_crc32", "shard")
    run = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(RUNS)).cast("int")
    placed = hand_over(placed.withColumn("run", run), "placed")
    # numbers inside a run of a shard, from where the shard's earlier runs end
    lengths = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    turn = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32"))
    placed = placed.withColumn("turn", turn).join(F.broadcast(lengths), ["shard", "run"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("turn") - 1).alias("slot"))
