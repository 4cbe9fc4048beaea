"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a self-join of binary tries.

Different fingerprints are dealt out five times, each time under another of five blocks of their bits. Two fingerprints
that differ in at most four bits agree in one block at least, so they meet in that block's trie. There the join walks
pairs of nodes together, adds the bits in which they differ, and leaves a pair as soon as the sum exceeds four. A trie
that is too large for one task is cut into pairs of its nodes further down, pruned by the same sum, and these are dealt
out in turn. Links found in a task leave it as stars around the smallest fingerprint, never as all pairs of a group.

A null text is an empty one and has fingerprint zero, like all texts without words, which are linked like any other.
Copies share one fingerprint and are not compared with each other. Rows without an id take part in links; an id of a
component is the smallest one present, null only where no row has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from taleweave.llm.common import as_bytes, slices, text_key, whole_text, without_rows, words
from taleweave.llm.components import components
from taleweave.session import hand_over

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
SHINGLE, SEED, ERRORS = 4, 42, 4
#: Fingerprints that one trie may hold before it is cut further down.
TRIE_LIMIT = 50_000

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: First bit and width of each block, from the highest bit.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Node pairs with so few pairs of fingerprints are compared at once.
_LEAF = 64


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """A bit is one if it is set in over half of the shingles' hashes."""
    out = []
    weigh = np.uint64(1) << np.arange(64, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for part in slices(texts, 1 << 20):
        data, start = as_bytes(part)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        begin, end = words(data, _GAP)
        bounds = np.searchsorted(begin, start)
        size = end - begin
        # words side by side, one space after each
        keep = ~_GAP[data]
        keep[end] = True
        data[end] = 32
        packed = data[keep].tobytes()
        stop = np.cumsum(size + 1) - 1
        first = stop - size
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            n = hi - lo
            if not n:
                out.append(0)
                continue
            m = max(1, n - shingle + 1)
            ends = stop[lo + shingle - 1 : hi] if n >= shingle else stop[hi - 1 : hi]
            hashes = [digest(packed[a:b], SEED) for a, b in zip(first[lo : lo + m].tolist(), ends.tolist(), strict=True)]
            ones = np.zeros(64, np.int64)
            for k in range(0, m, 1 << 16):
                bits = np.array(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
            out.append(int(weigh[2 * ones > m].sum(dtype=np.uint64)))
    return np.array(out, np.uint64)


@F.arrow_udf(LongType())
def simhash(texts: pa.Array) -> pa.Array:
    return pa.array(fingerprints(texts).view(np.int64))


def _rotated(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """``x`` with bit ``bits`` (counted from the highest) brought to the front."""
    left = bits.astype(np.uint64)
    right = (np.uint64(64) - left) & np.uint64(63)
    return (x << left) | (x >> right)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fingerprint under each block: (block, value, fp)."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        block = np.repeat(np.arange(len(BLOCKS)), len(fp))
        all_fp = np.tile(fp, len(BLOCKS))
        at, width = (np.array([b[i] for b in BLOCKS])[block] for i in (0, 1))
        value = (_rotated(all_fp, at) >> (64 - width).astype(np.uint64)).astype(np.int32)
        yield pa.record_batch(
            [pa.array(block.astype(np.int32)), pa.array(value), pa.array(all_fp.view(np.int64))], ["block", "value", "fp"]
        )


def _near(bits: int) -> list[np.ndarray]:
    """For each prefix of ``bits`` bits, the prefixes within the error budget, itself included."""
    flips = np.array([m for m in range(1 << bits) if m.bit_count() <= ERRORS])
    return [p ^ flips for p in range(1 << bits)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Under each pair of nodes ``cut`` bits below the block that a fingerprint belongs to: adds (low, high)."""
    for batch in batches:
        block, value, fp, cut = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        rows, low, high = [], [], []
        whole = np.flatnonzero(cut == 0)
        rows.append(whole)
        low.append(np.zeros(len(whole), np.int64))
        high.append(np.zeros(len(whole), np.int64))
        for bits in np.unique(cut[cut > 0]):
            near = np.array(_near(int(bits)))
            at = np.flatnonzero(cut == bits)
            first = np.array([a + w for a, w in BLOCKS])[block[at]] % 64
            own = (_rotated(fp[at].view(np.uint64), first) >> np.uint64(64 - bits)).astype(np.int64)
            other = near[own]
            rows.append(np.repeat(at, other.shape[1]))
            low.append(np.minimum(own[:, None], other).ravel())
            high.append(np.maximum(own[:, None], other).ravel())
        at = np.concatenate(rows)
        columns = [block[at], value[at], cut[at], np.concatenate(low).astype(np.int32), np.concatenate(high).astype(np.int32), fp[at]]
        yield pa.record_batch([pa.array(c) for c in columns], ["block", "value", "cut", "low", "high", "fp"])


class _Forest:
    """Who is linked with whom, as parents among positions; the smallest position is a tree's root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self._mark()

    def _mark(self) -> None:
        self.changes = np.concatenate(([0], np.cumsum(self.parent[1:] != self.parent[:-1]))) if len(self.parent) else self.parent

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        parent = self.parent
        while True:
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up
        self._mark()

    def one_tree(self, a0, a1, b0, b1) -> np.ndarray:
        """Whether all positions of both ranges are linked already."""
        c, p = self.changes, self.parent
        return (c[a1 - 1] == c[a0]) & (c[b1 - 1] == c[b0]) & (p[a0] == p[b0])


def trie_links(keys: np.ndarray, start: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """Root of every key among those linked with it, directly or through others.

    ``keys`` are sorted within tries; a row of ``start`` is a pair of nodes to begin with: first and one-past-last
    position of each, bits that differ so far, and the depth reached. Equal ranges are a node with itself.
    """
    forest = _Forest(len(keys))
    stack = [start[i : i + chunk] for i in range(0, len(start), chunk)]
    while stack:
        a0, a1, b0, b1, err, depth = stack.pop().T
        live = ~forest.one_tree(a0, a1, b0, b1) | ((a0 == b0) & (a1 - a0 > 1) & (forest.changes[a1 - 1] != forest.changes[a0]))
        a0, a1, b0, b1, err, depth = (x[live] for x in (a0, a1, b0, b1, err, depth))
        if not len(a0):
            continue
        product = (a1 - a0) * (b1 - b0)
        small = (product <= _LEAF) | (depth >= 64)
        at = np.flatnonzero(small)
        for lo in range(0, len(at), 1 << 14):
            s = at[lo : lo + (1 << 14)]
            n = product[s]
            pair = np.repeat(np.arange(len(s)), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            wide = (b1 - b0)[s][pair]
            i, j = a0[s][pair] + k // wide, b0[s][pair] + k % wide
            once = i < j
            i, j = i[once], j[once]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= ERRORS
            forest.link(i[near], j[near])
        big = ~small
        if not big.any():
            continue
        a0, a1, b0, b1, err, depth = (x[big] for x in (a0, a1, b0, b1, err, depth))
        bit = np.uint64(63) - depth.astype(np.uint64)
        am, bm = _middle(keys, a0, a1, bit), _middle(keys, b0, b1, bit)
        own = (a0 == b0) & (a1 == b1)
        deeper = depth + 1
        children = [
            np.stack([a0, am, b0, bm, err, deeper], 1),
            np.stack([am, a1, bm, b1, err, deeper], 1),
            np.stack([a0, am, bm, b1, err + 1, deeper], 1),
            np.stack([am, a1, b0, bm, err + 1, deeper], 1)[~own],
        ]
        children = [c[(c[:, 0] < c[:, 1]) & (c[:, 2] < c[:, 3]) & (c[:, 4] <= ERRORS)] for c in children]
        across, along = np.concatenate(children[2:]), np.concatenate(children[:2])
        for part in (across, along):  # nodes with themselves come off the stack first
            stack += [part[i : i + chunk] for i in range(0, len(part), chunk)]
    return forest.parent


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First position in each range whose key has ``bit`` set; keys in a range agree in all higher bits."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        one = ((keys[mid] >> bit[open_]) & np.uint64(1)).astype(bool)
        hi[open_[one]] = mid[one]
        lo[open_[~one]] = mid[~one] + 1


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All tries and node pairs dealt to one task, joined in one walk; links as stars."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    columns = pa.Table.from_batches(parts)
    block, value, cut, low, high, fp = (columns.column(k).to_numpy() for k in range(6))
    fp = fp.view(np.uint64)
    at, width = (np.array([b[i] for b in BLOCKS])[block] for i in (0, 1))
    keys = _rotated(fp, at)
    order = np.lexsort((keys, high, low, cut, value, block))
    block, value, cut, low, high, keys, fp, width = (x[order] for x in (block, value, cut, low, high, keys, fp, width))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = np.any([x[1:] != x[:-1] for x in (block, value, cut, low, high)], axis=0)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(keys))
    start = np.stack([head, tail, head, tail, np.zeros(len(head)), width[head] + cut[head]], 1).astype(np.int64)
    crossed = np.flatnonzero(low[head] != high[head])
    if len(crossed):  # the two nodes stand side by side, parted where the bits below the block change
        h = head[crossed]
        below = (keys >> (64 - width - cut).astype(np.uint64)) & ((np.uint64(1) << cut.astype(np.uint64)) - np.uint64(1))
        second = np.add.reduceat((below != low).astype(np.int64), head)[crossed]
        middle = tail[crossed] - second
        start[crossed, 1] = start[crossed, 2] = middle
        start[crossed, 4] = np.bitwise_count((low[h] ^ high[h]).astype(np.uint64))
    start = start[(start[:, 0] < start[:, 1]) & (start[:, 2] < start[:, 3])]
    root = trie_links(keys, start)
    linked = np.flatnonzero(root != np.arange(len(root)))
    pairs = np.unique(np.stack([fp[linked], fp[root[linked]]]), axis=1)
    yield pa.record_batch([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], ["a", "b"])


def near_links(prints: DataFrame, limit: int = TRIE_LIMIT) -> DataFrame:
    """Links (a, b) between the different fingerprints in ``fp`` that connect all that differ in at most four bits."""
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.select("fp").mapInArrow(_deal, "block int, value int, fp long")
    sizes = dealt.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    # node pairs grow slower than the square of the nodes: twice the bits that would bring each node below the limit
    bits = F.least(F.lit(10), F.ceil(F.log2(F.col("n") / limit)).cast("int") + 1)
    dealt = dealt.join(sizes.select("block", "value", bits.alias("cut")), ["block", "value"], "left")
    dealt = dealt.select("block", "value", "fp", F.coalesce("cut", F.lit(0)).alias("cut"))
    cut = dealt.mapInArrow(_cut, "block int, value int, cut int, low int, high int, fp long")
    cut = cut.repartition(tasks, "block", "value", "low", "high")
    return cut.mapInArrow(_join, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, row, fp, root (smallest fingerprint) and component_id (smallest id among all rows reachable)."""
    rows = hand_over(docs.select("doc_id", text_key().alias("row"), simhash(whole_text()).alias("fp")), "fingerprints")
    prints = hand_over(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = hand_over(components(near_links(prints)), "roots")
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = hand_over(named.join(ids, "root").select("fp", "root", "component_id"), "components")
    return rows.join(named, "fp")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (and the smallest row key among its rows)."""
    groups = hand_over(near_groups(docs), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    rows = groups.join(first, "root").select(
        "doc_id",
        "row",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))).alias("kept"),
    )
    named = hand_over(rows.groupBy("doc_id", "row").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "verdict")
    return without_rows(docs, named.filter("not kept"), named.filter("kept and n > 1"))
