"""One model for two tasks: words share their weights between a class head and a next-word head.

Words fall into hashed buckets, each with a vector. A text's class scores come from the mean vector of its words, and the
scores of the word that follows from the vector of the word before. The loss is the sum of both mean cross entropies, and
every step of descent moves the shared vectors and both heads along the gradient of that sum.

What a step needs is put at rest once: each text's bucket shares, and how often one bucket follows another, which is all
the second loss depends on. In a step every task adds up the gradient of its rows, equal entries of the tasks are added by
key, and the driver holds the weights only, whose number depends on the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taleweave.functions.arrays import argmax, bind
from taleweave.session import hand_over

BUCKETS, WIDTH, STEPS, RATE = 1024, 16, 20, 1.0
# The start weights are (7919 i + 104729 j + 1299709 s) mod 10007, spread over -0.5 to 0.5.
START = (7919, 104729, 1299709, 10007)


def start_weights(rows: int, columns: int, salt: int) -> np.ndarray:
    a, b, c, m = START
    i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
    return ((a * i + b * j + c * salt) % m) / m - 0.5


def bucket(word: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("long") % buckets).cast("int")


@dataclass
class JointModel:
    """``words`` (bucket, width), ``classes`` (width, class) and ``following`` (width, bucket)."""

    words: np.ndarray
    classes: np.ndarray
    following: np.ndarray

    @classmethod
    def begin(cls, n_labels: int, buckets: int = BUCKETS, width: int = WIDTH) -> JointModel:
        return cls(start_weights(buckets, width, 1), start_weights(width, n_labels, 2), start_weights(width, buckets, 3))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.words, self.classes, self.following

    def moved(self, gradient: tuple[np.ndarray, ...], rate: float) -> JointModel:
        return JointModel(*[w - rate * g for w, g in zip(self.arrays(), gradient, strict=True)])

    def class_scores(self, buckets: np.ndarray, shares: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean vectors and class scores of ``n`` texts; entry k says that text ``row[k]`` has a share of a bucket."""
        mean = np.zeros((n, self.words.shape[1]))
        np.add.at(mean, row, shares[:, None] * self.words[buckets])
        return mean, mean @ self.classes

    def class_gradient(self, buckets, shares, row, label) -> tuple[float, tuple[np.ndarray, ...]]:
        """Summed cross entropy of the texts' classes and its gradient."""
        mean, z = self.class_scores(buckets, shares, row, len(label))
        p, loss = _softmax(z, np.arange(len(label)), label)
        p[np.arange(len(label)), label] -= 1
        words = np.zeros_like(self.words)
        np.add.at(words, buckets, shares[:, None] * (p @ self.classes.T)[row])
        return loss.sum(), (words, mean.T @ p, np.zeros_like(self.following))

    def next_gradient(self, before, after, row, count) -> tuple[float, tuple[np.ndarray, ...]]:
        """Summed cross entropy of what follows the buckets ``before`` and its gradient: entry k says that bucket
        ``after[k]`` follows ``before[row[k]]`` ``count[k]`` times."""
        vectors = self.words[before]
        p, _ = _softmax(vectors @ self.following, np.zeros(0, int), np.zeros(0, int))
        loss = float((-np.log(p[row, after]) * count).sum())
        times = np.bincount(row, count, len(before))
        gap = p * times[:, None]
        np.subtract.at(gap, (row, after), count)
        words = np.zeros_like(self.words)
        np.add.at(words, before, gap @ self.following.T)
        return loss, (words, np.zeros_like(self.classes), vectors.T @ gap)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(name, i, list(map(float, line))) for name, w in zip(_NAMES, self.arrays(), strict=True) for i, line in enumerate(w)]
        spark.createDataFrame(rows, "name string, i int, w array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> JointModel:
        rows = spark.read.parquet(path).orderBy("name", "i").collect()
        return cls(*[np.array([r["w"] for r in rows if r["name"] == name]) for name in _NAMES])


_NAMES = ("words", "classes", "following")


def _softmax(z: np.ndarray, row: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = z - z.max(1, keepdims=True)
    p = np.exp(z)
    total = p.sum(1, keepdims=True)
    return p / total, np.log(total[row, 0]) - z[row, label]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and the row each belongs to."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _gradients(model: JointModel, kind: str):
    """Tasks' sums as rows (name, i, j, v): the loss, the weights' gradient where it isn't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, total = 0.0, [np.zeros_like(w) for w in model.arrays()]
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second, third = (batch.column(k) for k in range(3))
            values, row = _lists(second)
            weights = _lists(third)[0]
            if kind == "class":
                more, gradient = model.class_gradient(values, weights, row, first.to_numpy())
            else:
                more, gradient = model.next_gradient(first.to_numpy(), values, row, weights)
            loss += more
            for t, g in zip(total, gradient, strict=True):
                t += g
        names, i, j, v = ["loss"], [0], [0], [loss]
        for name, t in zip(_NAMES, total, strict=True):
            at, to = np.nonzero(t)
            names += [name] * len(at)
            i += at.tolist()
            j += to.tolist()
            v += t[at, to].tolist()
        yield pa.record_batch(
            [pa.array(names), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.float64())], ["name", "i", "j", "v"]
        )

    return run


def bucket_shares(tokens: str, buckets: int) -> Column:
    """Buckets and shares of a token array."""

    def shares(b: Column) -> Column:
        found = F.array_distinct(b)
        share = F.transform(found, lambda x: F.size(F.filter(b, lambda y: y == x)) / F.size(b))
        return F.struct(found.alias("buckets"), share.alias("shares"))

    return bind(F.transform(tokens, lambda t: bucket(t, buckets)), shares)


def class_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """label, buckets and shares of each text (tokens, label)."""
    return texts.select(F.col("label").cast("int").alias("label"), bucket_shares("tokens", buckets).alias("c")).select("label", "c.*")


def next_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """before, after and count: for each bucket those that follow it in a text. At most ``buckets`` entries a row."""
    pair = F.arrays_zip(F.slice("b", 1, F.size("b") - 1).alias("before"), F.slice("b", 2, F.size("b")).alias("after"))
    coded = texts.select(F.transform("tokens", lambda t: bucket(t, buckets)).alias("b")).filter(F.size("b") > 1)
    pairs = coded.select(F.inline(pair)).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
    lists = pairs.groupBy("before").agg(F.sort_array(F.collect_list(F.struct("after", "n"))).alias("l"))
    return lists.select("before", F.col("l.after").alias("after"), F.col("l.n").cast("array<double>").alias("count"))


def fit_joint(
    texts: DataFrame, n_labels: int, buckets: int = BUCKETS, width: int = WIDTH, steps: int = STEPS, rate: float = RATE
) -> tuple[JointModel, DataFrame]:
    """Model of the texts (tokens, label), and each step's class_loss, next_loss and loss, the last after all steps."""
    spark = texts.sparkSession
    texts = hand_over(texts.select("tokens", "label"), "joint-texts")
    classes = hand_over(class_rows(texts, buckets), "joint-classes")
    following = hand_over(next_rows(texts, buckets), "joint-next")
    n = max(1, classes.count())
    pairs = following.agg(F.sum(F.aggregate("count", F.lit(0.0), lambda a, x: a + x))).first()[0] or 1.0
    model, history = JointModel.begin(n_labels, buckets, width), []
    schema = "name string, i int, j int, v double"
    for step in range(steps + 1):
        parts = []
        for kind, rows, size in (("class", classes, n), ("next", following, pairs)):
            sums = rows.mapInArrow(_gradients(model, kind), schema)
            parts.append(sums.withColumn("v", F.col("v") / size).withColumn("loss", F.lit(kind)))
        merged = F.when(F.col("name") == "loss", F.col("loss")).otherwise(F.lit("both"))
        total = parts[0].unionByName(parts[1]).groupBy(merged.alias("of"), "name", "i", "j").agg(F.sum("v").alias("v")).collect()
        gradient = tuple(np.zeros_like(w) for w in model.arrays())
        losses = {"class": 0.0, "next": 0.0}
        for r in total:
            if r["name"] == "loss":
                losses[r["of"]] = r["v"]
            else:
                gradient[_NAMES.index(r["name"])][r["i"], r["j"]] = r["v"]
        history.append((step, losses["class"], losses["next"], losses["class"] + losses["next"]))
        if step < steps:
            model = model.moved(gradient, rate)
    return model, spark.createDataFrame(history, "step int, class_loss double, next_loss double, loss double")


def score_joint(model: JointModel, texts: DataFrame, key: str) -> DataFrame:
    """key, split, z, pred and label of each text (key, split, tokens, label)."""
    buckets = len(model.words)
    coded = texts.select(key, "split", "label", bucket_shares("tokens", buckets).alias("c"))

    @F.arrow_udf("array<double>")
    def scores(found: pa.Array, shares: pa.Array) -> pa.Array:
        values, row = _lists(found)
        return pa.array(model.class_scores(values, _lists(shares)[0], row, len(found))[1].tolist(), pa.list_(pa.float64()))

    z = hand_over(coded.select(key, "split", scores("c.buckets", "c.shares").alias("z"), "label"), "joint-scores")
    return z.withColumn("pred", argmax(F.col("z")))
