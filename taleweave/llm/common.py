"""What several operators share: reading tables, learning samples, and views of Arrow strings as bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Texts are worked on in slices of about so many bytes, so that numpy's working arrays stay small.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by five. Rows without an id count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def row_key(*columns: str) -> list[Column]:
    """Parts of a null-safe join key over ``columns``."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]


class Sample(NamedTuple):
    """Labelled texts on the driver; ``weight`` restores the shares that the classes have among all labelled rows."""

    texts: pa.Array
    labels: np.ndarray
    weight: np.ndarray


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, seed: int) -> Sample:
    """At most ``rows`` learning texts of each class, of at most ``chars`` characters, chosen by a hash of the id.

    Rows held out are not used. A document with several labels counts by their mean. Ids are ranked before any text is
    read; the ids are few by definition (2 x ``rows``) and are broadcast to the documents.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = known.filter("y = 0").orderBy(rank, "doc_id").limit(rows)
    chosen = chosen.unionByName(known.filter("y = 1").orderBy(rank, "doc_id").limit(rows))
    short = docs.select("doc_id", whole_text().alias("text")).filter(F.length("text") <= chars)
    found = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = found.column("y").to_numpy().astype(np.int64)
    weight = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            weight[y == c] = counts[c] / (y == c).sum()
    texts = found.column("text").combine_chunks()
    return Sample(texts if len(y) else pa.array([], pa.string()), y, weight / weight.mean() if len(y) else weight)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of consecutive texts of about ``most`` bytes, one text at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield texts.slice(first, last - first)
        first = last


def as_bytes(texts: pa.Array, end: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by ``end``, and where each begins (one more entry than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(end, pa.large_string()))
    if not len(joined):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Base of the polynomial hash of words, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of every run of bytes that ``blank`` (a table of 256) does not mark."""
    gap = blank[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with well spread bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, begin: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the byte ranges from ``begin`` to each of ``ends``, from one running polynomial.

    Equal bytes have equal hashes, in whatever buffer and place they stand.
    """
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in ends]
    powers = np.cumprod(np.full(len(data), _BASE, np.uint64))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)))
    # a range that begins at b is scaled by BASE ** b: take that out again
    scale = np.cumprod(np.full(len(data), _INVERSE, np.uint64))[begin]
    return [mixed((running[end] - running[begin]) * scale + (end - begin).astype(np.uint64)) for end in ends]


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    """Steps of Adam over a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression of ``y`` on one value (Newton steps)."""
    x = np.stack([z, np.ones_like(z)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = logistic(x @ b)
        grad = x.T @ (weight * (y - p)) - ridge * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        move = np.linalg.solve(hess, grad)
        b += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def text_key(text: str = "text") -> Column:
    """With the id, what tells a row from others that repeat its id."""
    return F.xxhash64(whole_text(text))


def boxed(docs: DataFrame) -> Column:
    """A row's columns as one value, beside which working columns of any name can stand; ``doc.*`` unpacks it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def without_rows(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` less the rows named by (doc_id, row) in ``dropped``; of rows that ``repeated`` names, one stays.

    ``row`` is ``text_key``. All columns of ``docs`` are returned as they are.
    """

    def named(keys: DataFrame) -> DataFrame:
        return keys.select(row_key("doc_id")[0].alias("k0"), F.col("row").alias("k1")).distinct()

    keyed = docs.select(boxed(docs), row_key("doc_id")[0].alias("k0"), text_key().alias("k1"))
    left = keyed.join(named(dropped), ["k0", "k1"], "left_anti")
    if not repeated.isEmpty():
        again = named(repeated)
        once = left.join(again, ["k0", "k1"], "left_semi").dropDuplicates(["k0", "k1"])
        left = left.join(again, ["k0", "k1"], "left_anti").unionByName(once)
    return left.select("doc.*")
