"""Packing in the order of a space-filling curve.

A document becomes token ids and a closing id 0. Every token id has a fixed random direction; their mean is the
document's hashed vector, projected to three dimensions. Its cell's place on a Hilbert curve is the document's key. The
key's range is cut into runs (bounds come from a bounded sample and touch balance only), each run is sorted, and its
documents are laid end to end, so that neighbours on the curve share sequences.

Sequences hold 1024 ids and documents are cut where a sequence is full. What is left at the end of a run is cut into
powers of two, which need no padding. A null or empty text is its closing id alone. Rows that repeat an id are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from taleweave.llm.common import slices, text_key, whole_text
from taleweave.session import hand_over

LENGTH = 1024
#: Texts from whose keys the bounds of runs are taken.
SAMPLE_ROWS = 4_096
#: The same vocabulary as a tokenizer's description and as ranks.
TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
_SPECIAL = "<|endoftext|>"
_DIMS, _BITS = 3, 10


@lru_cache(2)
def _encoders(tokenizer: str, ranks: str):
    """A fast encoder from the ranks, and the tokenizer itself for texts that spell its special token."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return fast, Tokenizer.from_file(tokenizer)


def encode(text: str, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> np.ndarray:
    """Token ids as the tokenizer gives them without adding special tokens."""
    fast, whole = _encoders(tokenizer, ranks)
    if _SPECIAL in text:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.uint32, copy=False)


@lru_cache(1)
def _directions(size: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(29).normal(0, 1, (size, _DIMS)).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below 2 ** bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert place of each document's projected mean direction."""
    if not ids:
        return np.zeros(0, np.int64)
    size = np.array([len(x) for x in ids])
    table = _directions()
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    mean = np.add.reduceat(table[np.concatenate(ids) & 0xFFFF], starts, axis=0) / size[:, None]
    return hilbert(((np.tanh(2 * mean) + 1) / 2 * ((1 << _BITS) - 1)).astype(np.int64))


def _tokenized(bounds: np.ndarray, tokenizer: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for part in slices(column):
                at = part.offset - column.offset
                ids = [np.append(encode(t, tokenizer, ranks), np.uint32(0)) for t in part.to_pylist()]
                tie = batch.column("tie").slice(at, len(part)).to_numpy()
                key = (curve_keys(ids) << 32) | (tie & 0xFFFFFFFF)
                columns = [
                    batch.column("doc_id").slice(at, len(part)),
                    batch.column("row").slice(at, len(part)),
                    pa.array(key),
                    pa.array(np.searchsorted(bounds, key, side="right").astype(np.int32)),
                    pa.array([x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in ids], pa.binary()),
                    pa.array([bool(x.max() >= 1 << 16) for x in ids]),
                ]
                yield pa.record_batch(columns, ["doc_id", "row", "key", "run", "ids", "wide"])

    return run


_TOKENS = "doc_id long, row long, key long, run int, ids binary, wide boolean"
_PIECES = "run int, doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, turn long, offset long"


class _Packer:
    """Lays documents of one run end to end; only the sequence not yet full is held."""

    def __init__(self, run: int, length: int):
        self.run, self.length, self.turn, self.filled = run, length, 0, 0
        self.open: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc_id, row, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            size = min(self.length - self.filled, len(ids) - start)
            self.open.append((doc_id, row, start, ids[start : start + size], len(ids), self.filled))
            self.filled += size
            start += size
            if self.filled == self.length:
                self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        for doc_id, row, start, ids, total, offset in pieces:
            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
            self.out.append((self.run, doc_id, row, start, len(ids), crc, total, self.turn, offset))
        self.turn += 1

    def end(self) -> None:
        """The rest as sequences of falling powers of two."""
        rest, pieces = self.filled, list(reversed(self.open))
        while rest:
            size = 1 << (rest.bit_length() - 1)
            rest -= size
            filled, own = 0, []
            while filled < size:
                doc_id, row, start, ids, total, _ = pieces.pop()
                take = min(len(ids), size - filled)
                own.append((doc_id, row, start, ids[:take], total, filled))
                if take < len(ids):
                    pieces.append((doc_id, row, start + take, ids[take:], total, 0))
                filled += take
            self._close(own)
        self.open, self.filled = [], 0

    def batch(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        columns = zip(*self.out, strict=True)
        self.out = []
        return pa.record_batch([pa.array(c, pa.int32() if n == "run" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def _packed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            for doc_id, row, r, ids, wide in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "run", "ids", "wide")), strict=True):
                if packer is None or packer.run != r:
                    if packer is not None:
                        packer.end()
                        if packer.out:
                            yield packer.batch()
                    packer = _Packer(r, length)
                packer.add(doc_id, row, np.frombuffer(ids, "<u4" if wide else "<u2"))
                if len(packer.out) >= 10_000:
                    yield packer.batch()
        if packer is not None:
            packer.end()
            if packer.out:
                yield packer.batch()

    return run


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """A row for each piece: doc_id, row, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Token ids move once, from the task that makes them to the run that packs them. Sequences are numbered without gaps
    over all runs, by the runs' numbers of sequences.
    """
    spark = docs.sparkSession
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", whole_text().alias("text"), text_key().alias("row"))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "row"))
    few = rows.select("doc_id", "row", "tie").orderBy("tie", "doc_id").limit(SAMPLE_ROWS).select("tie").distinct()
    sample = rows.join(F.broadcast(few), "tie", "left_semi").select("doc_id", "text", "row", "tie")
    none = np.zeros(0, np.int64)
    keys = sample.mapInArrow(_tokenized(none, tokenizer, ranks), _TOKENS)
    keys = keys.select("key", F.octet_length("ids").cast("long").alias("size")).toArrow().sort_by("key")
    key, upto = keys.column("key").to_numpy(), np.cumsum(keys.column("size").to_numpy())
    goals = np.arange(1, runs) * (upto[-1] / runs if len(upto) else 0)  # runs of equal length in tokens
    bounds = np.unique(key[np.searchsorted(upto, goals)]) if len(key) else none
    tokens = rows.select("doc_id", "text", "row", "tie").mapInArrow(_tokenized(bounds, tokenizer, ranks), _TOKENS)
    tokens = tokens.repartitionById(len(bounds) + 1, F.col("run")).sortWithinPartitions("run", "key", "doc_id", "row")
    pieces = hand_over(tokens.mapInArrow(_packed(length), _PIECES), "pieces")
    counts = pieces.groupBy("run").agg((F.max("turn") + 1).alias("n"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row for each run
    base = counts.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(F.broadcast(base), "run").withColumn("sequence_id", F.col("base") + F.col("turn"))
    return numbered.select("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
