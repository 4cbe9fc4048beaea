"""Toxicity: a convolutional text classifier over hashed word embeddings, written and trained in numpy.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first four and six bytes. Filters one,
two and three words wide run over the whole text and beyond its end, their largest responses are kept, and a linear layer makes a logit of
them. The language is read off function words of the text itself, and the logit is calibrated with an offset for each
language, so that one half is that language's threshold.

Hashes that are in fewer than two learning texts have the zero vector, so rare words of other texts cannot collide into
meaning. A null text is an empty one; texts without words get the share of toxic texts as their score. Scoring has no
limit on length; repeated rows get equal scores; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from taleweave.llm.common import (
    Adam,
    Sample,
    as_bytes,
    labelled_sample,
    logistic,
    slices,
    whole_text,
    word_hashes,
    words,
)

#: Bounds of the learning sample: texts of each class, and characters of a text.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 10_000
THRESHOLD = 0.5

DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
SLOTS = 1 << 22
_CHUNK = 1 << 15

#: Frequent function words that tell four languages apart.
FUNCTION_WORDS = {
    "en": "the and of to that is was for with this are from it be by on as an",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine",
    "fr": "le la les des et est dans que une du qui par pour au sur avec pas ce",
    "es": "el los las y del en por con una su se lo al como más o pero sus",
}


def _letters() -> np.ndarray:
    gap = np.ones(256, bool)
    gap[48:58] = gap[65:91] = gap[97:123] = False
    gap[128:] = False
    return gap


_GAP = _letters()


@dataclass
class Words:
    """Slots of every word (itself, four bytes, six bytes) and where each text's words begin (n + 1 entries)."""

    slots: np.ndarray
    begin: np.ndarray


def read_words(texts: pa.Array) -> Words:
    data, start = as_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    if len(data) > 1:  # capital Latin letters with accents are two bytes in UTF-8
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 32
    begin, end = words(data, _GAP)
    hashes = word_hashes(data, begin, end, np.minimum(begin + 4, end), np.minimum(begin + 6, end))
    slots = np.stack([((h >> np.uint64(3 * k)) & np.uint64(SLOTS - 1)).astype(np.int32) for k, h in enumerate(hashes)])
    return Words(slots, np.searchsorted(begin, start))


def _language_slots() -> tuple[list[str], np.ndarray]:
    names = list(FUNCTION_WORDS)
    table = np.zeros(SLOTS, np.int8)
    for k, name in enumerate(names):
        table[read_words(pa.array([FUNCTION_WORDS[name]])).slots[0]] = k + 1
    return names, table


LANGUAGES, _LANGUAGE = _language_slots()


def language_of(w: Words) -> np.ndarray:
    """Index of the language with most function words, or the number of languages if there are none."""
    n, k = len(w.begin) - 1, len(LANGUAGES)
    doc = np.repeat(np.arange(n), np.diff(w.begin))
    hit = _LANGUAGE[w.slots[0]].astype(np.int64)
    votes = np.bincount(doc * (k + 1) + hit, minlength=n * (k + 1)).reshape(n, k + 1)[:, 1:]
    return np.where(votes.sum(1) > 0, votes.argmax(1), k)


def _tap(k: int, j: int) -> slice:
    """Columns of the ``j``-th word of the ``k``-th width among all filters' words."""
    first = (sum(WIDTHS[:k]) + j) * FILTERS
    return slice(first, first + FILTERS)


@dataclass
class Net:
    """``row`` maps a slot to its row of ``embedding``; row 0 is the zero vector of what was not learned."""

    row: np.ndarray
    embedding: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    slope: float
    offset: np.ndarray
    empty: float

    def responses(self, rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text (zero at least) and the word where it starts (-1: none)."""
        n, total = len(begin) - 1, rows.shape[1]
        best = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(best.shape, -1)
        doc = np.repeat(np.arange(n), np.diff(begin))
        for lo in range(0, total, _CHUNK):
            hi = min(lo + _CHUNK, total)
            far = min(hi + max(WIDTHS) - 1, total)
            table = self.embedding if self.projected is None else self.projected
            e = np.zeros((hi - lo + max(WIDTHS) - 1, table.shape[1]), np.float32)
            e[: far - lo] = table[rows[0, lo:far]] + table[rows[1, lo:far]] + table[rows[2, lo:far]]
            d = doc[lo:hi]
            head = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            docs = d[head]
            ahead = [e[: hi - lo]]  # the words one, two ... places on; zero beyond the text's end
            for j in range(1, max(WIDTHS)):
                same = np.zeros((hi - lo, 1), np.float32)
                m = min(hi, total - j) - lo
                if m > 0:
                    same[:m, 0] = doc[lo + j : lo + j + m] == d[:m]
                ahead.append(e[j : j + hi - lo] * same)
            for k, width in enumerate(WIDTHS):
                if self.projected is None:
                    z = sum(ahead[j] @ self.kernels[k][j] for j in range(width))
                else:
                    z = sum(ahead[j][:, _tap(k, j)] for j in range(width))
                z = z + self.bias[k * FILTERS : (k + 1) * FILTERS]
                top = np.maximum.reduceat(z, head)
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                better = top > best[docs, cols]
                if self.keep_places and better.any():
                    seg = np.repeat(np.arange(len(head)), np.diff(np.append(head, hi - lo)))
                    at, f = np.nonzero(z == top[seg])
                    place = np.zeros(top.shape, np.int64)
                    place[seg[at], f] = at + lo
                    where[docs, cols] = np.where(better, place, where[docs, cols])
                best[docs, cols] = np.maximum(best[docs, cols], top)
        return best, where

    keep_places: bool = False
    projected: np.ndarray | None = None

    def project(self) -> None:
        """Put every embedding through all filters once.

        A score is then a sum in one fixed order, so a text's score does not depend on the texts it is scored with.
        """
        taps = [self.kernels[k][j] for k, width in enumerate(WIDTHS) for j in range(width)]
        self.projected = np.concatenate([self.embedding @ tap for tap in taps], axis=1)

    def logits(self, w: Words) -> np.ndarray:
        best, _ = self.responses(self.row[w.slots], w.begin)
        return (best * self.out[:-1]).sum(1) + self.out[-1]

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for part in slices(texts):
            w = read_words(part)
            own = logistic(self.slope * self.logits(w) + self.offset[language_of(w)])
            out.append(np.where(np.diff(w.begin) > 0, own, self.empty))
        return np.concatenate(out) if out else np.zeros(0)


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, language: np.ndarray) -> tuple[float, np.ndarray]:
    """One slope, and an offset for each language that leans on the common one where a language has few texts."""
    k = len(LANGUAGES) + 1
    x = np.concatenate([z[:, None], np.ones((len(z), 1)), np.eye(k)[language]], 1)
    ridge = np.array([1e-2, 1e-3] + [1.0] * k)
    b = np.zeros(k + 2)
    for _ in range(60):
        p = logistic(x @ b)
        grad = x.T @ (weight * (y - p)) - ridge * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        b += np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(b[0]), b[1] + b[2:]


def fit(sample: Sample, steps: int = 1_000, batch: int = 32, rate: float = 0.05, seed: int = 5) -> Net:
    """Train on four fifths of the sample, calibrate on all of it (each text of the last fifth counts fourfold)."""
    rng = np.random.default_rng(seed)
    n = len(sample.labels)
    all_words = read_words(sample.texts)
    doc = np.repeat(np.arange(n), np.diff(all_words.begin))
    row = np.zeros(SLOTS, np.int32)
    pairs = np.unique(np.stack([all_words.slots.ravel(), np.tile(doc, 3)]), axis=1) if n else np.zeros((2, 0), int)
    slot, count = np.unique(pairs[0], return_counts=True)
    slot = slot[count >= 2].astype(np.int64)
    row[slot] = np.arange(1, len(slot) + 1)
    size = len(WIDTHS) * FILTERS
    embedding = rng.normal(0, 0.1, (len(slot) + 1, DIM)).astype(np.float32)
    embedding[0] = 0
    kernels = [rng.normal(0, (2 / (DIM * w)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias, out = np.zeros(size, np.float32), np.append(rng.normal(0, 0.3, size), 0).astype(np.float32)
    y = sample.labels.astype(np.float64)
    share = float((y * sample.weight).sum() / sample.weight.sum()) if n else 0.5
    net = Net(row, embedding, kernels, bias, out, 1.0, np.zeros(len(LANGUAGES) + 1), share)
    if len(set(y)) < 2:
        out[:] = 0
        net.project()
        net.offset[:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    net.keep_places = True
    rows = row[all_words.slots]
    fold = np.zeros(n, bool)
    fold[rng.permutation(n)[: n // 5]] = True
    learn = np.flatnonzero(~fold)
    each = np.where(y == 1, 0.5 / max(1, (y[learn] == 1).sum()), 0.5 / max(1, (y[learn] == 0).sum())) * len(learn)
    adam = Adam([*kernels, bias, out], 0.01)
    past = np.full(len(embedding), 1e-6)
    for _ in range(-(-steps * batch // len(learn))):
        order = rng.permutation(learn)
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            span = [np.arange(all_words.begin[i], all_words.begin[i + 1]) for i in chosen]
            begin = np.concatenate(([0], np.cumsum([len(s) for s in span])))
            own = rows[:, np.concatenate(span)]
            best, where = net.responses(own, begin)
            p = logistic(best @ out[:-1] + out[-1])
            g = (each[chosen] * (p - y[chosen]) / len(chosen)).astype(np.float32)
            up = g[:, None] * out[:-1] * (where >= 0)
            d_kernels, d_bias = [np.zeros_like(k) for k in kernels], up.sum(0)
            touched, moves = [], []
            for k, width in enumerate(WIDTHS):
                d, f = np.nonzero(where[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
                at, u = where[d, k * FILTERS + f], up[d, k * FILTERS + f]
                for j in range(width):
                    inside = at + j < begin[d + 1]
                    ids = np.where(inside, own[:, np.minimum(at + j, own.shape[1] - 1)], 0)
                    e = embedding[ids].sum(0)
                    np.add.at(d_kernels[k][j].T, f, u[:, None] * e)
                    touched.append(ids.ravel())
                    moves.append(np.tile(u[:, None] * kernels[k][j][:, f].T, (3, 1)))
            d_out = np.append(g @ best, g.sum()).astype(np.float32) + 1e-4 * out
            ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            d_rows = np.zeros((len(ids), DIM), np.float32)
            np.add.at(d_rows, inverse, np.concatenate(moves))
            past[ids] += (d_rows**2).mean(1)
            embedding[ids] -= (rate / np.sqrt(past[ids]))[:, None] * d_rows
            embedding[0] = 0
            adam.step([*d_kernels, d_bias, d_out])
    net.keep_places = False
    net.project()
    net.slope, net.offset = _calibrate(
        net.logits(all_words), y, sample.weight * np.where(fold, 4.0, 1.0), language_of(all_words)
    )
    return net


def train_toxicity(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, seed: int = 13
) -> Broadcast:
    """The fitted network, sent once to each executor: its size depends on the sample and on SLOTS alone."""
    net = fit(labelled_sample(docs, labels, "toxic", rows, chars, seed))
    return docs.sparkSession.sparkContext.broadcast(net)


def toxicity_score(model: Broadcast, text: str = "text") -> Column:
    """Probability that a text is toxic, as a column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.score(texts))

    return score(whole_text(text))
