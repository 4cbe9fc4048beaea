"""Vector code compression: product codes whose nearest entries are found under an integer Walsh-Hadamard transform.

A vector's components become integers floor(scale * x); vectors are cut into equal consecutive parts, and every part
position has a codebook of at most ``entries`` integer entries, refined in rounds of assignment and floored means. Parts and
entries are padded with zeros to a power of two P and transformed by an integer Walsh-Hadamard matrix H in sequency order.
As H'H = P, the squared differences of the coefficients add up to exactly P times the squared distance; most of it lies in
the first coefficients, so the sums are taken in that order and an entry is left as soon as its sum exceeds the full one of
the entry that looked best. No floating point is involved after the components became integers: where 64 bits might not
hold a sum, the same steps run on Python's integers.

A round is one pass over the vectors: tasks add up their parts by (part, entry), these sums are added by key, and only
the codebooks (parts x entries rows) reach the driver. Nothing is gathered by entry, so a frequent vector costs nothing more.

Rows whose vector is null or holds null, NaN or infinite components are dropped. Shorter vectors are filled with zeros up to
the longest one, and that to a multiple of ``parts``. The first entries are the vectors of the smallest ids (null ids
last, equal ids by vector); fewer vectors make fewer entries. Sums beyond a long are given as the largest long. Null labels
are one label. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from taleweave.session import hand_over

#: Parts of a vector, entries of a codebook, rounds of refinement, and the factor before components are floored.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors transformed at a time.
_SLICE = 4096
_MOST = 2**63 - 1


def sequency(size: int) -> np.ndarray:
    """Where the natural order of a transform of ``size`` has the coefficients of rising numbers of sign changes."""
    k = np.arange(size)
    gray = k ^ (k >> 1)
    bits = size.bit_length() - 1
    out = np.zeros(size, np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Integer transform of the last axis, whose length is a power of two, in sequency order."""
    size = x.shape[-1]
    step = 1
    while step < size:
        pairs = x.reshape(*x.shape[:-1], size // (2 * step), 2, step)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        x = np.stack([a + b, a - b], -2).reshape(x.shape)
        step *= 2
    return x[..., sequency(size)]


def padded(x: np.ndarray) -> np.ndarray:
    """The last axis filled with zeros up to a power of two."""
    size = 1 << max(0, x.shape[-1] - 1).bit_length()
    out = np.zeros((*x.shape[:-1], size), x.dtype)
    out[..., : x.shape[-1]] = x
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row (the first of equally near ones) and ``size`` times its squared distance.

    Both are transformed. The first coefficients give every entry a lower bound; the entry with the least one is summed
    up, and the others only as long as they may still be as near.
    """
    rows, size = x.shape
    first = max(1, size // 4)
    partial = ((x[:, None, :first] - entries[None, :, :first]) ** 2).sum(-1)
    guess = partial.argmin(1)
    bound = partial[np.arange(rows), guess] + ((x[:, first:] - entries[guess, first:]) ** 2).sum(-1)
    row, entry = np.nonzero((partial <= bound[:, None]).astype(bool))
    total = partial[row, entry]
    at = first
    while at < size and len(row):
        to = min(size, 2 * at)
        total = total + ((x[row, at:to] - entries[entry, at:to]) ** 2).sum(-1)
        live = (total <= bound[row]).astype(bool)
        row, entry, total = row[live], entry[live], total[live]
        at = to
    # pairs are in order of row, then entry: the first of the least sums of a row stays
    order = np.lexsort((entry, total, row))
    row, entry, total = row[order], entry[order], total[order]
    head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
    return entry[head], total[head]


def _integer(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def integers(vectors: pa.Array, width: int, scale: int, most: int) -> np.ndarray:
    """A row of ``width`` integers for each vector; of Python's where one exceeds ``most``."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if len(values) and np.abs(values).max() * scale >= most:
        out = np.zeros((len(sizes), width), object)
        out[row, place] = [_integer(v, scale) for v in values.tolist()]
        return out
    out = np.zeros((len(sizes), width), np.int64)
    out[row, place] = np.floor(values * scale).astype(np.int64)
    return out


class Codebooks:
    """Entries of all part positions: ``entries[part][entry]`` is a list of integers."""

    def __init__(self, entries: list[list[list[int]]], parts: int, width: int, scale: int):
        self.entries, self.parts, self.width, self.scale = entries, parts, width, scale
        size = 1 << max(0, width // parts - 1).bit_length()
        #: Components and entries below this keep all sums of squares within 63 bits.
        self.most = math.isqrt(2**61) // size
        self.size = size

    def assign(self, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of the vectors: integers (row, part, place), entries (row, part) and squared distances (row, part)."""
        largest = max((abs(v) for part in self.entries for e in part for v in e), default=0)
        wide = largest >= self.most
        books = np.array(self.entries, object if wide else np.int64)
        books = walsh_hadamard(padded(books.reshape(self.parts, -1, self.width // self.parts)))
        for at in range(0, len(vectors), _SLICE):
            whole = integers(vectors.slice(at, _SLICE), self.width, self.scale, self.most)
            cut = whole.reshape(len(whole), self.parts, -1)
            moved = walsh_hadamard(padded(cut.astype(object) if wide else cut))
            found = [nearest(moved[:, p], books[p].astype(moved.dtype)) for p in range(self.parts)]
            yield cut, np.stack([f[0] for f in found], 1), np.stack([f[1] // self.size for f in found], 1)

    def sha256(self) -> str:
        values = ",".join(str(v) for part in self.entries for entry in part for v in entry)
        return hashlib.sha256(values.encode()).hexdigest()


def kept(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is whole, as vec_id, label and vector of doubles."""
    values = F.col(vector).cast("array<double>")
    rows = vectors.select("vec_id", "label", values.alias("vector")).filter(F.col("vector").isNotNull())
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~broken)


def _sums(books: Codebooks):
    """A task's parts added up by (part, entry); sums as text, which holds integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, m = len(books.entries[0]), books.width // books.parts
        counts = np.zeros((books.parts, k), np.int64)
        sums = np.zeros((books.parts, k, m), object)
        for batch in batches:
            for cut, entry, _ in books.assign(batch.column(0)):
                for p in range(books.parts):
                    n = np.bincount(entry[:, p], minlength=k)
                    order = np.argsort(entry[:, p], kind="stable")
                    head = (np.cumsum(n) - n)[n > 0]
                    sums[p, n > 0] += np.add.reduceat(cut[order, p], head, axis=0).astype(object)
                    counts[p] += n
        part, entry = np.nonzero(counts)
        texts = [[str(v) for v in sums[p, e]] for p, e in zip(part, entry, strict=True)]
        yield pa.record_batch(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(texts, pa.list_(pa.string()))],
            ["part", "entry", "n", "sums"],
        )

    return run


def _means(rows: pd.DataFrame) -> pd.DataFrame:
    """Floored means of one entry from the sums of all tasks."""
    n = int(rows["n"].sum())
    totals = [sum(map(int, column)) for column in zip(*rows["sums"], strict=True)]
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "entry": [rows["entry"].iloc[0]], "mean": [[str(t // n) for t in totals]]})


def train_codebooks(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks:
    """Codebooks of the vectors in ``rows`` (see ``kept``), which every round reads once."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    head = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    first = [[_integer(v, scale) for v in r["vector"]] + [0] * (width - len(r["vector"])) for r in head]
    m = width // parts
    books = Codebooks([[v[p * m : (p + 1) * m] for v in first] for p in range(parts)], parts, width, scale)
    for _ in range(rounds if first else 0):
        sums = rows.select("vector").mapInArrow(_sums(books), "part int, entry int, n long, sums array<string>")
        means = sums.groupBy("part", "entry").applyInPandas(_means, "part int, entry int, mean array<string>")
        following = [list(part) for part in books.entries]
        for r in means.collect():
            following[r["part"]][r["entry"]] = [int(v) for v in r["mean"]]
        books = Codebooks(following, parts, width, scale)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distance to the entries) of each vector."""
    id_type, label_type = (rows.schema[c] for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, entry, distance in books.assign(batch.column(2)):
                codes += [bytes(e).hex() for e in entry.astype(np.uint8)]
                errors += [min(int(e), _MOST) for e in distance.astype(object).sum(1)]
            columns = [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.record_batch(columns, ["vec_id", "label", "code", "error"])

    added = [StructField("code", StringType()), StructField("error", LongType())]
    return rows.select("vec_id", "label", "vector").mapInArrow(run, StructType([id_type, label_type, *added]))


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (errors added up over equal labels) and codebooks_sha256 of every whole vector."""
    if entries > 256:
        raise ValueError("an entry's index has two hex digits: at most 256 entries")
    rows = hand_over(kept(vectors, vector), "vectors")
    books = train_codebooks(rows, parts, entries, rounds)
    coded = hand_over(encode(rows, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(_MOST).cast("decimal(20,0)")).cast("long")
    totals = hand_over(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
