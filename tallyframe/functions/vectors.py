"""Array expressions for class scores (one array per row, one element per class)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def log_softmax(logits: Column) -> Column:
    """Natural log of the softmax; shifting by the maximum keeps ``exp`` finite."""
    top = F.array_max(logits)
    shift = top + F.log(_total(F.transform(logits, lambda x: F.exp(x - top))))
    return F.transform(logits, lambda x: x - shift)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = _total(F.transform(logits, lambda x: F.exp(x - top)))
    return F.transform(logits, lambda x: F.exp(x - top) / total)


def argmax(values: Column) -> Column:
    """Zero-based index of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confidence(probabilities: Column) -> Column:
    return F.array_max(probabilities)


def cross_entropy(
    log_probabilities: Column,
    target: Column,
    weights: Column | None = None,
    smoothing: float = 0.0,
) -> Column:
    """Cross entropy of one row, class-weighted and label-smoothed.

    ``(1-e)*w[y]*(-logp[y]) + e/k * sum_c w[c]*(-logp[c])``, not averaged.
    """
    at = target.cast("int") + 1
    hit = -F.element_at(log_probabilities, at)
    if weights is not None:
        hit = hit * F.element_at(weights, at)
    if not smoothing:
        return hit
    terms = (
        log_probabilities
        if weights is None
        else F.zip_with(log_probabilities, weights, lambda lp, w: lp * w)
    )
    spread = -_total(terms) / F.size(log_probabilities)
    return hit * (1.0 - smoothing) + spread * smoothing


def focal_term(ce: Column, gamma: float = 5.0) -> Column:
    """``(1-p)^gamma * ce`` with ``p = exp(-ce)`` taken from the (weighted, smoothed) ce."""
    return F.pow(F.lit(1.0) - F.exp(-ce), F.lit(float(gamma))) * ce


def symmetric_kl_term(log_p: Column, log_q: Column) -> Column:
    """``(KL(q||p) + KL(p||q)) / 2`` of one row.

    Both divergences share the factor ``log q - log p``, so their sum is
    ``sum((q - p) * (log q - log p))``.
    """
    return (
        _total(F.zip_with(log_p, log_q, lambda a, b: (F.exp(b) - F.exp(a)) * (b - a))) / 2.0
    )
