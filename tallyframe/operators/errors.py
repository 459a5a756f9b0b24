"""Misclassified rows, with their text and class names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.cells import DEFAULT_BY
from tallyframe.storage import settle

_SLICES = 64


def errors(predictions: DataFrame) -> DataFrame:
    """Rows whose prediction differs from the truth; a null prediction is an error."""
    wrong = ~F.col("y_pred").eqNullSafe(F.col("y_true"))
    return predictions.where(F.col("y_true").isNotNull() & wrong)


def first_errors(
    predictions: DataFrame, k: int = 20, by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """The first ``k`` errors of each group in row order.

    Ranked twice: inside hashed slices of a group, then among the slice winners,
    so no task sorts a whole group however large it is.
    """
    slice_of = F.pmod(F.xxhash64("row_idx"), F.lit(_SLICES)).alias("slice")
    sliced = errors(predictions).select("*", slice_of)
    local = Window.partitionBy(*by, "slice").orderBy("row_idx")
    whole = Window.partitionBy(*by).orderBy("row_idx")
    return (
        sliced.withColumn("place", F.row_number().over(local))
        .where(F.col("place") <= k)
        .withColumn("place", F.row_number().over(whole))
        .where(F.col("place") <= k)
        .drop("slice")
    )


def errors_by_confidence(predictions: DataFrame, k: int | None = None) -> DataFrame:
    """Errors from most to least confident; with ``k`` only the top of the list.

    Task and row break ties, so a confidence shared by many rows still spreads
    over the sort's ranges.
    """
    found = errors(predictions)
    ties = [c for c in ("run", "task", "row_idx") if c in found.columns]
    ranked = found.orderBy(F.desc("confidence"), *ties)
    return ranked if k is None else ranked.limit(k)


def attach_text(
    found: DataFrame, examples: DataFrame, text: str = "text", key: str = "row_idx"
) -> DataFrame:
    """Add the text of each row by key; null where there is no example of that key.

    ``found`` is written first: a top-k list is then small enough for the planner
    to broadcast, and the text table is not shuffled.
    """
    texts = examples.select(key, text)
    return settle(found, "errors").join(texts, key, "left")
