"""Array and score expressions (all evaluated inside the JVM)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let x = value in body(x)``: ``value`` is computed once however often ``body`` uses it.

    The fold has nothing to add; unlike a transform of one element it does not copy what ``body`` returns.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def argmax(scores: Column) -> Column:
    """Index of the first maximum, counted from zero."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sigmoid(scores: Column) -> Column:
    return F.transform(scores, lambda x: 1 / (1 + F.exp(-x)))


def above(scores: Column, threshold: float = 0.5, on_probabilities: bool = False) -> Column:
    """One 0/1 cell per score: is it, or the probability it stands for, above the threshold."""
    values = sigmoid(scores) if on_probabilities else scores
    return F.transform(values, lambda x: (x > F.lit(threshold)).cast("int"))


def softmax(scores: Column) -> Column:
    """Stable softmax of an array."""
    return bind(
        F.array_max(scores),
        lambda top: bind(
            F.transform(scores, lambda x: F.exp(x - top)),
            lambda e: bind(total(e), lambda s: F.transform(e, lambda x: x / s)),
        ),
    )


def logsumexp(scores: Column) -> Column:
    return bind(
        F.array_max(scores),
        lambda top: top + F.log(total(F.transform(scores, lambda x: F.exp(x - top)))),
    )


def nll(scores: Column, label: Column) -> Column:
    """Negative log-likelihood of class ``label`` (from zero) under softmax of ``scores``."""
    return logsumexp(scores) - F.element_at(scores, (label + 1).cast("int"))


def bce_cell(score: Column, target: Column) -> Column:
    """Binary cross entropy of one raw score, in its overflow-free form."""
    y = target.cast("double")
    return F.greatest(score, F.lit(0.0)) - score * y + F.log1p(F.exp(-F.abs(score)))
