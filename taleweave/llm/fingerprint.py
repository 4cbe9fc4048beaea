"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a paragraph.

A paragraph is a line; a long one ends early after pieces whose hash says so. It is cut into pieces at sentence ends, after
words whose hash says so, and after six words at the latest. Runs without blanks are cut where a rolling hash of the last
bytes says so, and no piece is longer than ``PIECE_BYTES``. So cuts depend on what stands around them and meet again after
an edit, in any script. A section ends after an empty paragraph or one whose hash says so.

A leaf is the 64-bit hash of a piece, a paragraph's node the hash of its leaves, a section's node the hash of its
paragraphs, the root a SHA-256 prefix over the sections. The fingerprint is the root, then the leaves by section (``/``) and
paragraph (``|``), from which every inner node follows.

Equal roots mean equal texts. Two trees are compared from the root down: equal nodes on both sides are set against each
other and not opened, of the others the children are compared in turn. ``likeness`` is the share of leaves in equal branches
(twice those, over all), ``differences`` names the paragraphs that have no equal. Both measure alike at every length.

A null text is an empty one; two empty texts are alike by 1, an empty and another by 0. An empty table gives an empty result;
other columns are not looked at. There is no limit on length.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from taleweave.llm.common import as_bytes, mixed, slices, whole_text, word_hashes, words

#: A piece has so many words and bytes at most; a word in about so many ends one.
PIECE_WORDS, PIECE_BYTES, PIECE_ODDS = 6, 128, 3
#: In a run of so many bytes without blanks, a place in about so many ends a piece, by a hash of the bytes before it.
RUN_BYTES, RUN_ODDS, ROLLING = 64, 48, 16
#: A leaf in about so many ends a paragraph before its line ends; a paragraph in about so many ends a section.
PARAGRAPH_ODDS, SECTION_ODDS = 64, 4

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
#: Digits of a leaf in a fingerprint.
_DIGITS = 16


@dataclass
class Level:
    """Nodes of one level of several trees, in order: the parent in the level above, digest, and leaves below."""

    parent: np.ndarray
    digest: np.ndarray
    leaves: np.ndarray


@dataclass
class Trees:
    """Fingerprints of several texts, and their sections, paragraphs and leaves; a section's parent is its text."""

    prints: list[str]
    levels: list[Level]


def _rolling_cuts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places inside long runs where the hash of the bytes before says so."""
    long = end - begin > RUN_BYTES
    if not long.any():
        return np.zeros(0, np.int64)
    first, size = begin[long], (end - begin)[long] - ROLLING
    at = np.arange(size.sum()) + np.repeat(first + ROLLING - np.cumsum(size) + size, size)
    value = np.zeros(len(at), np.uint64)
    for k in range(ROLLING):
        value = value * np.uint64(0x100000001B3) + data[at - ROLLING + k]
    return at[mixed(value) % np.uint64(RUN_ODDS) == 0]


def _cuts(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin (with the end of the last), and whether each ends a line. Texts end with a line break."""
    begin, end = words(data, _GAP)
    # a piece starts with its first word, takes the blanks after its last one, and stops at a line's end
    line_end = np.flatnonzero(data == 10) + 1
    opening = np.zeros(0, np.int64)
    if len(begin):
        hashes = word_hashes(data, begin, end)[0]
        closes = _STOP[data[end - 1]] | (hashes % np.uint64(PIECE_ODDS) == 0)
        line = np.searchsorted(line_end, begin, side="right")
        closes[:-1] |= line[1:] != line[:-1]
        closes[-1] = True
        group = np.concatenate(([0], np.cumsum(closes)[:-1]))
        head = np.concatenate(([0], np.flatnonzero(closes)[:-1] + 1))
        opens = (np.arange(len(begin)) - head[group]) % PIECE_WORDS == 0
        opens[1:] &= line[1:] == line[:-1]
        opens[0] = False
        opening = begin[opens]
    cuts = np.unique(np.concatenate(([0], line_end, opening, _rolling_cuts(data, begin, end))))
    # what is still too long is cut into equal lengths from its beginning
    parts = -(-np.diff(cuts) // PIECE_BYTES)
    if (parts > 1).any():
        turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts = np.append(np.repeat(cuts[:-1], parts) + turn * PIECE_BYTES, cuts[-1])
    return cuts, np.isin(cuts[1:], line_end, assume_unique=True)


def trees(texts: pa.Array) -> Trees:
    """Trees of all texts."""
    data, start = as_bytes(texts)
    n = len(texts)
    if not n:
        none = Level(*[np.zeros(0, np.int64)] * 3)
        return Trees([], [none, none, none])
    cuts, line_ends = _cuts(data, start)
    # the text's end mark is not part of its last piece
    stop = cuts[1:] - np.isin(cuts[1:], start[1:], assume_unique=False)
    leaf = word_hashes(data, cuts[:-1], stop)[0]
    closes = line_ends | (leaf % np.uint64(PARAGRAPH_ODDS) == 0)
    doc = np.searchsorted(start, cuts[:-1], side="right") - 1
    last = np.flatnonzero(closes) + 1
    first = np.concatenate(([0], last[:-1]))
    raw, names = leaf.astype("<u8").tobytes(), leaf.astype(">u8").tobytes().hex()
    digest = xxhash.xxh64_intdigest
    spans = list(zip(first.tolist(), last.tolist(), strict=True))
    nodes = np.array([digest(raw[8 * a : 8 * b]) for a, b in spans], np.uint64)
    # a section ends after an empty line, by its paragraph's hash, and with its text
    over = doc[first]
    ends = (nodes % np.uint64(SECTION_ODDS) == 0) | ((stop - cuts[:-1])[first] <= 1) & (last - first == 1)
    ends |= np.append(over[1:] != over[:-1], True)
    section_last = np.flatnonzero(ends) + 1
    section_first = np.concatenate(([0], section_last[:-1]))
    inner = nodes.astype("<u8").tobytes()
    joined, tops = [], []
    for a, b in zip(section_first.tolist(), section_last.tolist(), strict=True):
        joined.append("|".join([names[_DIGITS * x : _DIGITS * y] for x, y in spans[a:b]]))
        tops.append(digest(inner[8 * a : 8 * b]))
    top = np.array(tops, np.uint64)
    top_doc = over[section_first]
    bounds = np.searchsorted(top_doc, np.arange(n + 1)).tolist()
    prints = []
    for i in range(n):
        lo, hi = bounds[i], bounds[i + 1]
        prints.append(f"{hashlib.sha256(top[lo:hi].astype('<u8').tobytes()).hexdigest()[:32]}:{'/'.join(joined[lo:hi])}")
    below = last - first
    section = np.repeat(np.arange(len(top)), section_last - section_first)
    paragraph = np.repeat(np.arange(len(nodes)), below)
    levels = [
        Level(top_doc, top, np.bincount(section, below, len(top)).astype(np.int64)),
        Level(section, nodes, below),
        Level(paragraph, leaf, np.ones(len(leaf), np.int64)),
    ]
    return Trees(prints, levels)


def _matched(pair: np.ndarray, digest: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which nodes have an equal one of the same pair on the other side, each set against one only."""
    order = np.lexsort((side, digest, pair))
    p, d, s = pair[order], digest[order], side[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
    group = np.cumsum(fresh) - 1
    head = np.flatnonzero(fresh)
    right = np.bincount(group, s, len(head)).astype(np.int64)
    left = np.bincount(group, minlength=len(head)) - right
    both = np.minimum(left, right)[group]
    place = np.arange(len(p)) - head[group] - np.where(s == 1, left[group], 0)
    out = np.zeros(len(p), bool)
    out[order] = place < both
    return out


def likeness(a: Trees, b: Trees, pick_a: range, pick_b: range) -> np.ndarray:
    """Likeness of two runs of texts, taken pair by pair: down from the roots, through nodes that have no equal."""
    n = len(pick_a)
    same = np.array([a.prints[i][:32] == b.prints[j][:32] for i, j in zip(pick_a, pick_b, strict=True)], bool)
    shared = np.zeros(n)
    open_: list[np.ndarray] = []  # of each side, which nodes of the level above are compared, and for which pair
    total = np.zeros(n)
    for tree, pick in ((a, pick_a), (b, pick_b)):
        pair_of = np.full(len(tree.prints), -1)
        pair_of[pick.start : pick.stop] = np.arange(n)
        top = tree.levels[0]
        total += np.bincount(np.maximum(pair_of[top.parent], 0), top.leaves * (pair_of[top.parent] >= 0), n)
        open_.append(np.where(pair_of >= 0, np.where(same[pair_of], -1, pair_of), -1) if n else pair_of)
    for k in range(3):
        at, pair, digest, leaves, side = [], [], [], [], []
        for which, tree in enumerate((a, b)):
            level = tree.levels[k]
            own = open_[which][level.parent]
            live = np.flatnonzero(own >= 0)
            at.append(live)
            pair.append(own[live])
            digest.append(level.digest[live])
            leaves.append(level.leaves[live])
            side.append(np.full(len(live), which))
        pairs, sides = np.concatenate(pair), np.concatenate(side)
        equal = _matched(pairs, np.concatenate(digest), sides)
        shared += np.bincount(pairs[equal], np.concatenate(leaves)[equal], n)
        for which, tree in enumerate((a, b)):
            following = np.full(len(tree.levels[k].parent), -1)
            mine = sides == which
            following[at[which]] = np.where(equal[mine], -1, pairs[mine])
            open_[which] = following
    return np.where(same, 1.0, shared / np.maximum(total, 1))


def _sections(print_: str) -> list[list[str]]:
    return [section.split("|") for section in print_.split(":")[1].split("/")]


def print_likeness(a: str, b: str) -> float:
    """The likeness of two texts from their fingerprints."""
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    sides = [_sections(a), _sections(b)]
    total = sum(len(p) // _DIGITS for side in sides for section in side for p in section)
    shared = 0
    for level in range(3):
        # sections, paragraphs and leaves in turn; nodes without an equal are opened
        keys = [Counter("|".join(x) if level == 0 else x for x in side) for side in sides]
        both = keys[0] & keys[1]
        shared += 2 * sum(len(k.replace("|", "")) // _DIGITS * c for k, c in both.items())
        if level < 2:
            rest = [(x - both).elements() for x in keys]
            sides = [
                [p for s in side for p in s.split("|")] if level == 0
                else [p[i : i + _DIGITS] for p in side for i in range(0, len(p), _DIGITS)]
                for side in rest
            ]
    return shared / max(1, total)


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Paragraphs (section, paragraph) of the second fingerprint's text that the first has no equal of.

    Equal roots end the search at once; nodes that have an equal on the other side are not opened.
    """
    if a.split(":")[0] == b.split(":")[0]:
        return []
    left, right = _sections(a), _sections(b)
    known = Counter("|".join(s) for s in left)
    opened: Counter = Counter()
    places = []
    for i, section in enumerate(right):
        if known["|".join(section)] > 0:
            known["|".join(section)] -= 1
        else:
            places += [(i, j, p) for j, p in enumerate(section)]
    for section, n in known.items():
        for p in section.split("|"):
            opened[p] += n
    out = []
    for i, j, p in places:
        if opened[p] > 0:
            opened[p] -= 1
        else:
            out.append((i, j))
    return out


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, each with the one after it as the next document."""
    n = len(ids)
    edited = []
    for text, after in itertools.pairwise(texts):
        m = len(text) // 3
        edited.append(text[: len(text) - m] + after[:m])
    own, other = trees(pa.array(texts, pa.string())), trees(pa.array(edited, pa.string()))
    return pa.record_batch(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(own.prints[:-1]),
            pa.array(other.prints),
            pa.array(likeness(own, other, range(n), range(n))),
            pa.array(likeness(own, own, range(n), range(1, n + 1))),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a run in order; the run's last document is followed by the first that was sent ahead."""
    ids, texts = [], []
    for batch in batches:
        for part in slices(batch.column("text")):
            at = part.offset - batch.column("text").offset
            ahead = batch.column("ahead").slice(at, len(part)).to_pylist()
            rows = len(part) if True not in ahead else ahead.index(True)
            part = part.to_pylist()
            ids += batch.column("doc_id").slice(at, rows).to_pylist()
            texts += part[:rows]
            if rows < len(part):
                if ids:
                    yield _compared(ids, [*texts, part[rows]])
                return
            if len(ids) > 1:
                yield _compared(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint next to that of an edited text (its last third replaced by the next one's beginning).

    Documents follow each other by falling doc_id, after the last comes the first; rows that share an id follow each
    other by text, rows without an id come last. Ids alone are read first, to cut their range into runs. Each row then
    moves to its run, and the first document of a run to the run before it as well, so texts move once.
    """
    spark = docs.sparkSession
    runs = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308))
    ids = docs.select("doc_id", place.alias("place"))
    cuts = ids.agg(F.percentile_approx("place", [i / runs for i in range(1, runs)], 100 * runs)).first()[0]
    splits = [-float("inf"), *sorted(set(cuts or [0.0])), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="place", outputCol="run")
    run = (F.lit(len(splits) - 2) - F.col("run").cast("int")).alias("run")
    found = cut.transform(ids).select("doc_id", run).groupBy("run").agg(F.max("doc_id").alias("head")).collect()
    heads = sorted((r["run"], r["head"]) for r in found)  # one for each run
    before = [(r, head, heads[k - 1][0]) for k, (r, head) in enumerate(heads)]
    table = spark.createDataFrame(before, "run int, head long, before int")
    rows = cut.transform(docs.select("doc_id", whole_text().alias("text"), place.alias("place"))).select("doc_id", "text", run)
    marked = rows.join(F.broadcast(table), "run").select(
        "doc_id",
        "text",
        F.when(
            F.col("doc_id").eqNullSafe(F.col("head")),
            F.array(
                F.struct(F.col("run"), F.lit(False).alias("ahead")),
                F.struct(F.col("before").alias("run"), F.lit(True).alias("ahead")),
            ),
        )
        .otherwise(F.array(F.struct(F.col("run"), F.lit(False).alias("ahead"))))
        .alias("to"),
    )
    moved = marked.select("doc_id", "text", F.explode("to").alias("to")).select("doc_id", "text", "to.run", "to.ahead")
    moved = moved.repartitionById(len(splits) - 1, F.col("run"))
    moved = moved.sortWithinPartitions("run", "ahead", F.col("doc_id").desc_nulls_last(), "text")
    return moved.select("doc_id", "text", "ahead").mapInArrow(_walk, _OUT)
