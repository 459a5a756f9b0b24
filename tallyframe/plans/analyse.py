"""Error analysis of one or more runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyframe.operators.cells import DEFAULT_BY, confusion_cells, confusion_matrix
from tallyframe.operators.errors import attach_text, first_errors
from tallyframe.operators.labels import decode
from tallyframe.operators.metrics import classification_report
from tallyframe.storage import settle


def analyse_errors(
    predictions: DataFrame,
    encoder: DataFrame,
    examples: DataFrame,
    k: int = 20,
    text: str = "text",
    by: Sequence[str] = DEFAULT_BY,
) -> dict[str, DataFrame]:
    """Report, dense confusion matrix and the first errors with text and class names."""
    cells = settle(confusion_cells(predictions, by), "cells")
    found = attach_text(first_errors(predictions, k, by), examples, text)
    return {
        "report": classification_report(cells, encoder, by),
        "matrix": confusion_matrix(cells, encoder, by),
        "errors": decode(found, encoder),
    }
