"""N-gram Jaccard join by a token-group matrix: documents whose sets of word shingles are similar are linked.

Different sets are partitioned into groups of similar ones. The matrix is kept sparse: a set's tokens are dealt to parts by
their hash, and a row of the matrix says which groups hold a part of that content. There are more parts than tokens in which
linked sets can differ, so two linked sets agree in a part. A set queries the groups it shares a part with. Where a group is,
the overlap of the query with the union of the group's tokens bounds the overlap with any member; only groups whose bound
reaches the threshold are opened, and the query is compared with their members.

* Sizes of linked sets differ by the threshold at most, so sets are classed by size: linked sets are in the same class or in
  neighbouring ones, and post their parts for their own class and, near its lower end, for the one below. A class whose sets
  can differ in D tokens has D + 1 + spare parts. Parts without tokens are no rows of the matrix; a set with more of them than
  are spare may agree with another such set in empty parts only, so these few sets share one more row.
* Copies are one set. Sets that share no part with another are done. A group is the sets with the same most shared part,
  dealt into groups of about ``MEMBERS`` where they are many.
* Members of a group are compared first. Where sets with the same part make several groups, they are dealt out anew twice, so that a large cluster is joined before any set queries a group. A row of the matrix asks only across sets
  that are not joined yet: a cluster of any size asks nothing of itself.
* Rows of the matrix are joined group with group; which members of a group ask another one follows from that. A cluster has
  many most shared parts, and so a few large groups and many small ones: of two groups the one with fewer members to ask asks.
* A group's members are sent to as many tasks as its queries need. Texts are sent, not tokens, which are larger. A query
  is told one link with all members that are joined already, so no more links leave a task than joined sets came into it.
* Few sets share a part with another. Before texts move, a bitmap of these sets' keys takes most others out where they lie.

Words and shingles are compared by 64-bit hashes, sets by 128 bits. A text of fewer words than a shingle has its whole
sequence as one shingle. Null texts and texts without words have no shingles and no links; their component is their own id.
Rows without an id take part in links; an id of a component is the smallest one present, null only where no row has one. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from taleweave.llm.common import as_bytes, mixed, row_key, slices, text_key, whole_text, word_hashes, words
from taleweave.llm.components import components
from taleweave.session import discard, hand_over

#: Words of a shingle, and the similarity from which sets are linked, in hundredths.
SHINGLE, LEAST = 3, 90
#: Steps of the threshold that a class of sizes spans.
SPAN = 3
#: Sets of a group, and tokens above which fewer sets make one.
MEMBERS, TOKENS = 128, 500_000
#: Queries that one copy of a group's members answers.
QUERIES_A_COPY = 2_000
#: Further deals of the sets that share a least part.
DEALS = 2
#: Most bits of the bitmap of keys, and bits for one key below that.
BITMAP, BITS_A_KEY = 1 << 28, 32

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def token_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of the texts: hashes of each text's different shingles in rising order, and where each text's begin."""
    for part in slices(texts, 1 << 19):
        data, start = as_bytes(part)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        begin, end = words(data, _GAP)
        bounds = np.searchsorted(begin, start)
        # words side by side, one space after each
        keep = ~_GAP[data]
        keep[end] = True
        data[end] = 32
        stop = np.cumsum(end - begin + 1) - 1
        first = stop - (end - begin)
        n = np.diff(bounds)
        m = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
        at = np.concatenate(([0], np.cumsum(m)))
        doc = np.repeat(np.arange(len(n)), m)
        word = np.arange(at[-1]) + np.repeat(bounds[:-1] - at[:-1], m)
        last = np.minimum(word + shingle - 1, np.repeat(bounds[1:], m) - 1)
        hashes = word_hashes(data[keep], first[word], stop[last])[0]
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        counts = np.bincount(doc[fresh], minlength=len(n))
        yield hashes[fresh], np.concatenate(([0], np.cumsum(counts)))


@cache
def size_classes(least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest size of each class up to ``most``, tokens in which linked sets of it and the next may differ, spare parts.

    Sets of q <= d tokens with a similarity of t have d <= q / t and differ in q (1 - t) / t tokens at most.
    """
    highs = [1]
    while highs[-1] < most:
        high = highs[-1]
        for _ in range(SPAN):
            high = max(high + 1, high * 100 // least)
        highs.append(high)
    high = np.array(highs)
    differ = high * (100 - least) // least
    return high, differ, 1 + differ // 64


def signatures(tokens: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the matrix for each set, and where each set's begin: hashes of (class, part, the part's tokens)."""
    size = np.diff(at)
    most = int(size.max()) if len(size) else 1
    high, differ, spare = size_classes(least, 1 << max(4, most.bit_length()))
    own = np.searchsorted(high, np.maximum(size, 1))
    doc = np.repeat(np.arange(len(size)), size)
    spread = mixed(tokens ^ np.uint64(0x5851F42D4C957F2D))
    weight = mixed(tokens + np.uint64(0x14057B7EF767814F))
    found, owner = [], []
    for below in (0, 1):
        label = own - below
        # sets that can differ in no token are equal, so there is nothing to look for
        live = (label >= 0) & (size > 0) & (differ[label] > 0)
        if below:  # a linked set of the class below is not smaller than the threshold says
            live &= size * least <= high[label] * 100
        label = np.where(live, label, 0)
        parts = np.where(live, differ[label] + 1 + spare[label], 0)
        first = np.concatenate(([0], np.cumsum(parts)))
        mine = live[doc]
        d = doc[mine]
        cell = first[d] + (spread[mine] % np.maximum(parts[d], 1).astype(np.uint64)).astype(np.int64)
        total = np.zeros(first[-1], np.uint64)
        np.add.at(total, cell, weight[mine])
        full = np.zeros(first[-1], bool)
        full[cell] = True
        whose = np.repeat(np.arange(len(size)), parts)
        place = np.arange(first[-1]) - first[whose] if len(whose) else whose
        name = mixed(label[whose].astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))
        found.append(mixed(total[full] ^ name[full]))
        owner.append(whose[full])
        empty = np.bincount(whose[~full], minlength=len(size))
        rare = np.flatnonzero(live & (empty > spare[label]))
        found.append(mixed(label[rare].astype(np.uint64) + np.uint64(1 << 62)))
        owner.append(rare)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(size))
    return found[order], np.concatenate(([0], np.cumsum(counts)))


def _lists(values: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *values])
    offsets = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes])))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


_NAME = [StructField(n, LongType()) for n in ("size", "s1", "s2")]
_PARTS = StructField("parts", ArrayType(LongType()))


def _names(tokens: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Size of each set and 128 bits that name it."""
    size = np.diff(at)
    out = [size]
    for k in (1, 2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(tokens * np.uint64(2 * k + 1)))))
        out.append(mixed(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)).view(np.int64))
    return out


def _sketch(shingle: int, least: int, parts: bool):
    """Size and name of a text's set and, if asked for, its rows of the matrix."""

    @F.arrow_udf(StructType([*_NAME, _PARTS] if parts else _NAME))
    def sketch(texts: pa.Array) -> pa.Array:
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        rows, counts = [], []
        for tokens, at in token_sets(texts, shingle):
            for column, values in zip(columns, _names(tokens, at), strict=True):
                column.append(values)
            if parts:
                found, where = signatures(tokens, at, least)
                rows.append(found)
                counts.append(np.diff(where))
        flat = [pa.array(np.concatenate(c)) for c in columns]
        if parts:
            return pa.StructArray.from_arrays([*flat, _lists(rows, counts)], ["size", "s1", "s2", "parts"])
        return pa.StructArray.from_arrays(flat, ["size", "s1", "s2"])

    return sketch


def _sets(texts: pa.ChunkedArray | pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts' sets, and where each set's begin."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    parts = list(token_sets(texts, shingle))
    sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(at) for _, at in parts]])
    return np.concatenate([np.zeros(0, np.uint64), *[tokens for tokens, _ in parts]]), np.cumsum(sizes)


class _Group:
    """Members of a group side by side: their tokens as places in the union of all."""

    def __init__(self, rows: pa.Table, shingle: int, least: int):
        self.least = least
        self.node = rows.column("node").to_numpy()
        tokens, self.at = _sets(rows.column("text"), shingle)
        self.size = np.diff(self.at)
        self.union, self.place = np.unique(tokens, return_inverse=True)
        self.root = np.arange(len(self.node))
        # what members are joined with already, and what these joined sets have become since
        self.known = rows.column("root" if "root" in rows.column_names else "node").to_numpy().copy()
        self.into: dict[int, int] = {}

    def _like(self, has: np.ndarray, size: int, members: np.ndarray) -> np.ndarray:
        """Those of ``members`` that are similar to a set of ``size`` tokens, marked in ``has``."""
        n = self.size[members]
        fits = np.minimum(n, size) * 100 >= self.least * np.maximum(n, size)
        members, n = members[fits], n[fits]
        if not len(members):
            return members
        ends = np.cumsum(n)
        token = np.arange(ends[-1]) + np.repeat(self.at[members] - ends + n, n)
        both = np.add.reduceat(has[self.place[token]].astype(np.int64), ends - n)
        return members[100 * both >= self.least * (n + size - both)]

    def compare(self) -> Iterator[tuple[int, int]]:
        """Links that join all similar members, directly or through others."""
        has = np.zeros(len(self.union), bool)
        for k in range(len(self.node) - 1):
            rest = np.arange(k + 1, len(self.node))
            rest = rest[self.root[rest] != self.root[k]]
            if not len(rest):
                continue
            mine = self.place[self.at[k] : self.at[k + 1]]
            has[mine] = True
            near = self._like(has, int(self.size[k]), rest)
            has[mine] = False
            for j in near:
                if self.root[j] != self.root[k]:
                    low, high = sorted((self.root[j], self.root[k]))
                    self.root[self.root == high] = low
                    yield int(self.node[k]), int(self.node[j])

    def answer(
        self, nodes: np.ndarray, tokens: np.ndarray, at: np.ndarray, roots: np.ndarray | None = None
    ) -> Iterator[tuple[int, int]]:
        """Links of queries with members: all of them or, with the queries' ``roots``, those that join what is apart."""
        if not len(self.union) or not len(tokens):
            return
        place = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        inside = self.union[place] == tokens
        count = np.concatenate(([0], np.cumsum(inside)))
        overlap, size = count[at[1:]] - count[at[:-1]], np.diff(at)
        # no member has more in common with a query than their union has
        open_ = np.flatnonzero(100 * overlap >= self.least * np.maximum(size, self.size.min()))
        has = np.zeros(len(self.union), bool)
        everyone = np.arange(len(self.node))
        for q in open_:
            members = everyone
            if roots is not None:
                root = int(roots[q])
                while root in self.into:
                    root = self.into[root]
                members = everyone[self.known != root]
                if not len(members):
                    continue
            mine = place[at[q] : at[q + 1]][inside[at[q] : at[q + 1]]]
            has[mine] = True
            near = self._like(has, int(size[q]), members)
            has[mine] = False
            if roots is not None:
                old, first = np.unique(self.known[near], return_index=True)
                near = near[first]
                self.known[np.isin(self.known, old)] = root
                self.into.update((int(r), root) for r in old)
            for j in near:
                yield int(nodes[q]), int(self.node[j])


def _pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with the same first ``keys`` columns; a run that goes on in the next batch comes in pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)
        head = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]).any(1))))
        for lo, hi in zip(head, np.append(head[1:], len(values)), strict=True):
            yield tuple(values[lo].tolist()), batch.slice(lo, hi - lo)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare(shingle: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within groups, whose rows follow each other."""
        now, held, out = None, [], []
        for key, piece in _pieces(batches, 1):
            if key != now and held:
                out += _Group(pa.Table.from_batches(held), shingle, least).compare()
                held = []
            now = key
            held.append(piece)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        if held:
            out += _Group(pa.Table.from_batches(held), shingle, least).compare()
        yield _links(out)

    return run


def _open(shingle: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of queries with the members of a group, which come before them."""
        now, held, group, out = None, [], None, []
        for (key, copy, asks), piece in _pieces(batches, 3):
            if (key, copy) != now:
                now, held, group = (key, copy), [], None
            if not asks:
                held.append(piece)
                continue
            group = group or _Group(pa.Table.from_batches(held), shingle, least)
            out += group.answer(piece.column(3).to_numpy(), *_sets(piece.column(5), shingle), piece.column(4).to_numpy())
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` less most of those whose key (k0, k1) is not in ``wanted``; all that are in it stay.

    They are told by a bitmap of the keys' hashes, which is the same small table for every task: 32 MB at most.
    """
    bits = min(BITMAP, max(1 << 15, 1 << (BITS_A_KEY * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("k0", "k1"), F.lit(bits)) + 1
    key = [F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")]
    marks = wanted.select(*key).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("marks"))
    byte = F.conv(F.hex(F.expr("substring(marks, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("long")
    likely = texts.select("*", *key).join(F.broadcast(marks), "bucket")
    return likely.filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(*texts.columns)


def _counted(known: DataFrame) -> DataFrame:
    """``known`` (node, group, size, root) with the group's members, its most frequent root and members of other roots."""
    roots = known.groupBy("group", "root").agg(F.count("*").alias("n"))
    main = F.max(F.struct("n", "root"))
    groups = roots.groupBy("group").agg(F.sum("n").alias("members"), main["root"].alias("main"), main["n"].alias("n"))
    groups = groups.select("group", "members", "main", (F.col("members") - F.col("n")).alias("others"))
    return known.join(groups, "group")


def set_links(
    docs: DataFrame, nodes: DataFrame, parts: DataFrame, shingle: int = SHINGLE, least: int = LEAST, members: int = MEMBERS
) -> DataFrame:
    """Links (a, b) between the nodes that join all similar ones, directly or through others.

    ``nodes`` are at rest: node, size, and k0 and k1, the key of a row of ``docs`` with the node's text, which ``once``
    says is the only one. ``parts`` (node, parts) are at rest too, and deleted once the matrix is made.
    """
    posted = parts.select("node", F.explode("parts").alias("part"))
    shared = posted.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1")
    # shared parts and nodes grow with the table: they are never broadcast, so that every size is worked on alike
    matrix = hand_over(posted.join(hand_over(shared, "shared-parts").hint("merge"), "part"), "matrix")
    discard(parts)
    # groups: sets with the same most shared part
    most = F.max(F.struct("n", F.xxhash64("part").alias("home")))
    homes = matrix.groupBy("node").agg(most["home"].alias("home"))
    homes = hand_over(nodes.join(homes, "node"), "homes")
    counts = homes.groupBy("home").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    deal = F.ceil(F.greatest(F.col("n") / members, F.col("tokens") / TOKENS)).cast("int")
    homes = homes.join(hand_over(counts.select("home", deal.alias("deals")), "deals"), "home")

    def group(turn: int) -> Column:
        return F.xxhash64("home", F.lit(turn), F.expr(f"pmod(xxhash64(node, {turn}), deals)"))

    homes = hand_over(homes.withColumn("group", group(0)), "groups")
    texts = docs.select(row_key("doc_id")[0].alias("k0"), text_key().alias("k1"), whole_text().alias("text"))
    sets = _likely(texts, homes).join(homes.hint("merge"), ["k0", "k1"]).select("node", "group", "home", "deals", "once", "text")
    if not homes.filter("not once").isEmpty():
        sets = sets.filter("once").unionByName(sets.filter("not once").dropDuplicates(["node"]))
    sets = hand_over(sets, "sets")
    # members of a group, and those of large clusters in other company
    crowd = sets.filter("deals > 1")
    rows = sets.select("group", "node", "text")
    for turn in range(1, DEALS + 1):
        rows = rows.unionByName(crowd.select(group(turn).alias("group"), "node", "text"))
    rows = rows.repartition(_tasks(docs), "group").sortWithinPartitions("group")
    inside = hand_over(rows.mapInArrow(_compare(shingle, least), "a long, b long"), "links-inside")
    joined = hand_over(components(inside), "joined").withColumnRenamed("node", "named")
    # rows of the matrix across sets that are not joined yet, group with group
    known = homes.join(joined, F.col("node") == F.col("named"), "left")
    known = known.select("node", "group", "size", F.coalesce("root", "node").alias("root"))
    known = hand_over(_counted(hand_over(known, "joined-sets")), "known")
    cells = matrix.join(known.hint("merge"), "node").groupBy("part", "group", "members", "main", "others").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.min("root").alias("first"), F.max("root").alias("last")
    )
    cells = hand_over(cells, "cells")
    open_ = cells.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first != last")
    cells = hand_over(cells.join(open_.select("part"), "part", "left_semi"), "open-cells")
    own = cells.select("part", *[F.col(c).alias(f"own_{c}") for c in cells.columns if c != "part"])
    pure, own_pure = F.col("first") == F.col("last"), F.col("own_first") == F.col("own_last")
    fits = (F.col("own_high") * 100 >= least * F.col("low")) & (F.col("high") * 100 >= least * F.col("own_low"))
    apart = ~(pure & own_pure & (F.col("first") == F.col("own_first")))
    # of two groups one asks: the one that asks less, else the one of the smaller number
    cost = F.when(pure & (F.col("first") == F.col("own_main")), F.col("own_others")).otherwise(F.col("own_members"))
    back = F.when(own_pure & (F.col("own_first") == F.col("main")), F.col("others")).otherwise(F.col("members"))
    turn = (cost < back) | ((cost == back) & (F.col("own_group") < F.col("group")))
    pairs = own.join(cells, "part").filter((F.col("group") != F.col("own_group")) & fits & apart & turn)
    root = F.when(F.bool_and(pure) & (F.min("first") == F.max("first")), F.min("first"))
    pairs = pairs.groupBy("own_group", "group").agg(F.min("low").alias("low"), F.max("high").alias("high"), root.alias("single"))
    pairs = hand_over(pairs, "group-pairs")
    # members ask the other group, unless all it has for them is joined with them
    member = known.select("node", F.col("group").alias("own_group"), "size", "root")
    fits = (F.col("size") * 100 >= least * F.col("low")) & (F.col("high") * 100 >= least * F.col("size"))
    asks = member.join(pairs, "own_group").filter(fits & (F.col("single").isNull() | (F.col("single") != F.col("root"))))
    asks = hand_over(asks.select("node", "root", "group"), "queries")
    copies = asks.groupBy("group").agg(F.ceil(F.count("*") / QUERIES_A_COPY).cast("int").alias("copies"))
    copies = hand_over(copies, "copies")
    copy = F.expr("pmod(xxhash64(node), copies)").cast("int")
    asks = asks.join(copies, "group").select("group", copy.alias("copy"), F.lit(1).alias("asks"), "node", "root")
    every = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    opened = known.join(copies, "group").select("group", every.alias("copy"), F.lit(0).alias("asks"), "node", "root")
    rows = opened.unionByName(asks).join(sets.select("node", "text"), "node")
    rows = rows.select("group", "copy", "asks", "node", "root", "text")
    rows = rows.repartition(_tasks(docs), "group", "copy").sortWithinPartitions("group", "copy", "asks")
    across = rows.mapInArrow(_open(shingle, least), "a long, b long")
    stars = joined.select(F.col("named").alias("a"), F.col("root").alias("b"))
    return stars.unionByName(across)


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST, members: int = MEMBERS) -> DataFrame:
    """Each row's doc_id, n_shingles and component_id (the smallest id reachable by links, its own included)."""
    key = [row_key("doc_id")[0].alias("k0"), text_key().alias("k1")]
    rows = docs.select("doc_id", *key, _sketch(shingle, least, False)(whole_text()).alias("s"))
    rows = hand_over(rows.select("doc_id", "k0", "k1", "s.*"), "sketches")
    some = rows.filter("size > 0")
    same = some.groupBy("s1", "s2", "k0", "k1", "size").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    first = F.min(F.struct("k0", "k1", (F.col("n") == 1).alias("once"), "size"))
    nodes = same.groupBy("s1", "s2").agg(first.alias("of"), F.min("least").alias("least"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "least", "of.*")
    nodes = hand_over(nodes, "nodes")  # written before the numbers are read, so that they stand
    parts = docs.select(*key, _sketch(shingle, least, True)(whole_text())["parts"].alias("parts"))
    parts = parts.join(nodes.select("node", "once", "k0", "k1").hint("merge"), ["k0", "k1"]).filter(F.size("parts") > 0)
    if not nodes.filter("not once").isEmpty():
        parts = parts.filter("once").unionByName(parts.filter("not once").dropDuplicates(["node"]))
    parts = hand_over(parts.select("node", "parts"), "parts")
    links = set_links(docs, nodes.select("node", "size", "k0", "k1", "once"), parts, shingle, least, members)
    roots = hand_over(components(links), "roots").withColumnRenamed("node", "named")
    named = nodes.select("node", "s1", "s2", "least").join(roots, F.col("node") == F.col("named"), "left")
    named = hand_over(named.select("s1", "s2", "least", F.coalesce("root", "node").alias("root")), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = hand_over(named.join(ids, "root").select("s1", "s2", "component_id"), "component-ids")
    linked = some.join(named, ["s1", "s2"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    alone = rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
