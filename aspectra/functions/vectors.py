"""Score-vector expressions over ARRAY<DOUBLE> columns (one element per class).

All of these are higher-order array functions evaluated on the JVM, so a
prediction table never leaves Spark for softmax, fusion, voting or losses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: lambdas get it as a variable,
    where an expression inside a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shares(arr: Column) -> Column:
    return bind(arr, lambda a: bind(_sum(a), lambda total: F.transform(a, lambda x: x / total)))


def softmax(scores: Column) -> Column:
    """exp(s - max) / sum, the max subtracted for stability."""
    return bind(scores, lambda s: bind(F.array_max(s), lambda m: _shares(F.transform(s, lambda x: F.exp(x - m)))))


def log_sum_exp(scores: Column) -> Column:
    return bind(scores, lambda s: bind(F.array_max(s), lambda m: m + F.log(_sum(F.transform(s, lambda x: F.exp(x - m))))))


def argmax(scores: Column) -> Column:
    """0-based index of the largest element; the first one on ties."""
    return bind(scores, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def element(arr: Column, index0: Column) -> Column:
    """Element at a 0-based index (ANSI-safe: null when out of range)."""
    return F.try_element_at(arr, (index0 + 1).cast("int"))


def fuse_weighted(p_a: Column, p_b: Column, w_a: float = 0.8, w_b: float = 0.2) -> Column:
    """w_a * p_a + w_b * p_b per class, renormalised to sum to 1."""
    return _shares(F.zip_with(p_a, p_b, lambda a, b: F.lit(w_a) * a + F.lit(w_b) * b))


def fuse_vote(
    class_a: Column, scores_a: Column, class_b: Column, weight: float = 0.6, threshold: float = 0.4, at_a: Column | None = None
) -> Column:
    """Two-model vote: agree -> that class; otherwise A's class if its own raw
    score times ``weight`` exceeds ``threshold``, else B's class. ``at_a`` is the place of
    A's class in its scores, where classes are not 0, 1, 2 themselves."""
    own = element(scores_a, class_a if at_a is None else at_a)
    return (
        F.when(class_a == class_b, class_a)
        .when(own * F.lit(weight) > F.lit(threshold), class_a)
        .otherwise(class_b)
    )


def cross_entropy(scores: Column, label: Column) -> Column:
    """-s_y + ln(sum_j exp(s_j)) of a score vector against a 0-based label."""
    return log_sum_exp(scores) - element(scores, label)


def focal_loss(ce: Column, label: Column, alpha: Sequence[float] = (1.0, 1.0, 1.0), gamma: float = 2.5) -> Column:
    """alpha_y * (1 - pt)^gamma * ce with pt = exp(-ce)."""
    a = element(F.array(*[F.lit(float(x)) for x in alpha]), label)
    return a * F.pow(F.lit(1.0) - F.exp(-ce), F.lit(float(gamma))) * ce
