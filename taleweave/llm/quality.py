"""Quality classifier: a linear-chain conditional random field that labels every line of a text good or bad.

A line is described by shares of character classes, by its words and by the same values of the lines before and after
it. Forward-backward gives each line's marginal; marginals weighted by line length make the document's evidence, and a
logistic curve fitted on the learning texts turns that into a score between 0 and 1.

Labels exist for documents only. Lines of good texts count as good; in a bad text those lines count as bad that a
line-by-line model, fitted first, doesn't clearly hold to be good (one line at least).

A null text is an empty one; texts without any word get the share of good texts as their score. Scoring has no limit on
lines or length. Repeated rows get equal scores; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taleweave.llm.common import (
    Adam,
    Sample,
    as_bytes,
    labelled_sample,
    logistic,
    platt,
    slices,
    whole_text,
    word_hashes,
    words,
)

#: Bounds of the learning sample: texts of each class, and characters of a text.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 20_000
#: A score from here on keeps a document.
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _BLANK, _STOP, _SHOUT, _SYMBOL, _OTHER = range(8)


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    for chars, k in (
        (range(65, 91), _UPPER),
        (range(97, 123), _LOWER),
        (range(48, 58), _DIGIT),
        (b" \t\n\v\f\r", _BLANK),
        (b".,;:'\"-?()", _STOP),
        (b"!", _SHOUT),
        (b"#$%&*|<>{}[]=+_\\/^~@`", _SYMBOL),
    ):
        kind[list(chars)] = k
    return kind


_KIND = _classes()
_GAP = _KIND == _BLANK
#: Values of one line; each also enters as "above a tenth" and "above a half".
N_VALUES = 14


@dataclass
class Lines:
    """Lines with words of a run of texts: values, bytes, and for every text where its lines begin (n + 1 entries)."""

    values: np.ndarray
    size: np.ndarray
    begin: np.ndarray


def line_values(texts: pa.Array) -> Lines:
    data, start = as_bytes(texts)
    n = len(texts)
    if not n:
        return Lines(np.zeros((0, N_VALUES)), np.zeros(0), np.zeros(1, np.int64))
    stop = np.flatnonzero(data == 10)
    first = np.concatenate(([0], stop[:-1] + 1))
    size = stop - first
    line_of = np.repeat(np.arange(len(stop)), size + 1)
    counts = np.bincount(line_of * 8 + _KIND[data], minlength=8 * len(stop)).reshape(-1, 8).astype(np.float64)
    counts[:, _BLANK] -= 1  # the line's end

    begin, end = words(data, _GAP)
    hashes = word_hashes(data, begin, end)[0]
    at = line_of[begin]
    n_words = np.bincount(at, minlength=len(stop)).astype(np.float64)
    per_word = 1 / np.maximum(n_words, 1)
    same = np.zeros(len(begin), bool)
    if len(begin):
        same[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
    order = np.lexsort((hashes, at))
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (at[order][1:] != at[order][:-1])
    last_kind = _KIND[data[end - 1]] if len(end) else np.zeros(0, np.uint8)
    head_kind = _KIND[data[begin]] if len(begin) else np.zeros(0, np.uint8)
    tally = lambda mask: np.bincount(at[mask], minlength=len(stop)) * per_word

    letters = np.maximum(counts[:, _UPPER] + counts[:, _LOWER], 1)
    total = np.maximum(size, 1)
    doc = np.searchsorted(start, stop, side="right") - 1
    last_byte = _KIND[data[np.maximum(stop - 1, 0)]]
    values = np.stack(
        [
            counts[:, _UPPER] / letters,
            counts[:, _DIGIT] / total,
            counts[:, _SYMBOL] / total * 4,
            counts[:, _SHOUT] / total * 4,
            counts[:, _STOP] / total * 4,
            counts[:, _OTHER] / total,
            np.minimum(total * per_word / 12, 2),
            np.log1p(size) / 8,
            tally(same),
            tally(order[fresh]),
            tally(last_kind == _SYMBOL),
            tally((end - begin == 1) & (head_kind == _SYMBOL)),
            (last_byte == _STOP).astype(float),
            tally(head_kind == _UPPER),
        ],
        axis=1,
    )
    full = n_words > 0
    lines = np.bincount(doc[full], minlength=n)
    return Lines(values[full], size[full].astype(float), np.concatenate(([0], np.cumsum(lines))))


def chain_features(lines: Lines) -> np.ndarray:
    """A line's values with those of its neighbours inside the same text; zeros and a mark beyond its ends."""
    v = lines.values
    own = np.concatenate([v, v > 0.1, v > 0.5], 1)
    first, last = np.zeros(len(v), bool), np.zeros(len(v), bool)
    filled = np.flatnonzero(np.diff(lines.begin))
    first[lines.begin[filled]] = True
    last[lines.begin[filled + 1] - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after, first[:, None], last[:, None], np.ones((len(v), 1))], 1)


def _link(x: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """What log-odds ``x`` at one line say about the next one, with gains ``stay`` for keeping bad (0) or good (1)."""
    return np.logaddexp(x + stay[1], 0) - np.logaddexp(x, stay[0])


def forward_backward(unary: np.ndarray, begin: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each line from itself and what stands before, and from what comes after, for all texts in step."""
    count = np.diff(begin)
    order = np.argsort(-count, kind="stable")
    begin, count = begin[:-1][order], count[order]
    ahead, behind = unary.copy(), np.zeros_like(unary)
    longest = int(count[0]) if len(count) else 0
    alive = np.searchsorted(-count, -np.arange(longest), side="left")  # texts with more lines than t
    for t in range(1, longest):
        at = begin[: alive[t]] + t
        ahead[at] += _link(ahead[at - 1], stay)
    for t in range(longest - 1, 0, -1):
        at = begin[: alive[t]] + t
        behind[at - 1] = _link(unary[at] + behind[at], stay)
    return ahead, behind


def document_evidence(marginal: np.ndarray, lines: Lines) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, as log-odds; nan for texts without lines."""
    doc = np.repeat(np.arange(len(lines.begin) - 1), np.diff(lines.begin))
    weight = np.bincount(doc, lines.size, minlength=len(lines.begin) - 1)
    good = np.bincount(doc, lines.size * marginal, minlength=len(lines.begin) - 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.clip(good / weight, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


@dataclass
class Chain:
    """A fitted field and the curve that makes scores of its evidence."""

    weights: np.ndarray
    stay: np.ndarray
    slope: float
    offset: float
    empty: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for part in slices(texts):
            lines = line_values(part)
            unary = (chain_features(lines) * self.weights).sum(1)  # in one fixed order for each line
            ahead, behind = forward_backward(unary, lines.begin, self.stay)
            z = document_evidence(logistic(ahead + behind), lines)
            out.append(np.where(np.isnan(z), self.empty, logistic(self.slope * z + self.offset)))
        return np.concatenate(out) if out else np.zeros(0)


def _line_model(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
    w = np.zeros(x.shape[1])
    adam = Adam([w], 0.05)
    for _ in range(steps):
        adam.step([x.T @ (weight * (logistic(x @ w) - y)) + 1e-3 * w])
    return w


def fit(sample: Sample, steps: int = 200) -> Chain:
    """Maximum conditional likelihood by Adam over all sampled texts at once; gradients from exact marginals."""
    lines = line_values(sample.texts)
    good = float((sample.labels * sample.weight).sum() / max(sample.weight.sum(), 1e-9)) if len(sample.labels) else 0.5
    x = chain_features(lines)
    doc = np.repeat(np.arange(len(sample.labels)), np.diff(lines.begin))
    if not len(doc) or len(set(sample.labels[doc])) < 2:
        return Chain(np.zeros(x.shape[1]), np.zeros(2), 0.0, float(np.log((good + 1e-3) / (1 - good + 1e-3))), good)
    y = sample.labels[doc].astype(float)
    weight = np.ones(len(y))
    for c in (0, 1):
        weight[y == c] = 0.5 / (y == c).sum()
    clean = logistic(x @ _line_model(x, y, weight, steps))
    worst = np.full(len(sample.labels), np.inf)
    np.minimum.at(worst, doc, clean)
    y[(y == 0) & (clean > 0.8) & (clean > worst[doc])] = 1
    for c in (0, 1):
        weight[y == c] = 0.5 / (y == c).sum()

    w, stay = np.zeros(x.shape[1]), np.zeros(2)
    adam = Adam([w, stay], 0.05)
    linked = np.ones(len(y), bool)  # the line before is of the same text
    linked[lines.begin[np.flatnonzero(np.diff(lines.begin))]] = False
    right = np.flatnonzero(linked)
    left = right - 1
    n = len(y)
    for _ in range(steps):
        unary = x @ w
        ahead, behind = forward_backward(unary, lines.begin, stay)
        p = logistic(ahead + behind)
        m, v = ahead[left], unary[right] + behind[right]
        both = np.stack([np.full(len(left), stay[0]), m, v, m + v + stay[1]])
        both = np.exp(both - both.max(0))
        both /= both.sum(0)
        grad = np.array(
            [
                (both[0] - (1 - y[left]) * (1 - y[right])).sum(),
                (both[3] - y[left] * y[right]).sum(),
            ]
        )
        adam.step([x.T @ ((p - y) / n) + 1e-3 * w, grad / n + 1e-3 * stay])
    ahead, behind = forward_backward(x @ w, lines.begin, stay)
    z = document_evidence(logistic(ahead + behind), lines)
    seen = ~np.isnan(z)
    slope, offset = platt(z[seen], sample.labels[seen].astype(float), sample.weight[seen])
    return Chain(w, stay, slope, offset, good)


def train_quality(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, seed: int = 11
) -> Chain:
    return fit(labelled_sample(docs, labels, "quality", rows, chars, seed))


def quality_score(model: Chain, text: str = "text") -> Column:
    """Probability that a text is good, as a column."""
    shared = model

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.score(texts))

    return score(whole_text(text))
