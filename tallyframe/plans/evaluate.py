"""Vectors to predictions to metrics, for every task in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyframe.operators.cells import confusion_cells
from tallyframe.operators.metrics import task_metrics
from tallyframe.operators.scoring import predict, score_heads
from tallyframe.storage import settle


def evaluate_scores(
    vectors: DataFrame,
    vec_col: str,
    heads: DataFrame,
    truth: DataFrame,
    key: str = "row_idx",
    by: Sequence[str] = ("task",),
) -> dict[str, DataFrame]:
    """Score all heads, join the truth ``(key, task, y_true)`` and count.

    A judged row without a score is a null prediction, and so a wrong one.

    Returns ``predictions`` (lazy), ``cells`` (settled) and ``metrics``.
    """
    scored = predict(score_heads(vectors, vec_col, heads, keep=[key]))
    answers = scored.select(key, "task", "y_pred", "confidence")
    predictions = truth.join(answers, [key, "task"], "left")
    cells = settle(confusion_cells(predictions, by), "cells")
    return {"predictions": predictions, "cells": cells, "metrics": task_metrics(cells, by)}
