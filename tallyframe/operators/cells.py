"""Confusion counts: the one reduction every metric starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.storage import lookup_join, settle

DEFAULT_BY = ("run", "task")


def confusion_cells(predictions: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """Rows per (true, predicted) pair.

    A null prediction is kept: it is a wrong answer of no class.  A row without
    truth cannot be judged and is left out; ``rejected_rows`` counts those.
    """
    return (
        predictions.where(F.col("y_true").isNotNull())
        .groupBy(*by, "y_true", "y_pred")
        .agg(F.count("*").alias("n"))
    )


def rejected_rows(predictions: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    return (
        predictions.where(F.col("y_true").isNull())
        .groupBy(*by)
        .agg(F.count("*").alias("rejected"))
    )


def confusion_matrix(
    cells: DataFrame, encoder: DataFrame, by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """Every (true class, predicted class) of the encoder with its count, zeros included.

    Each class row unfolds into the k entries of its matrix line, so the work is
    the size of the matrix asked for.
    """
    sized = encoder.groupBy("task").agg(F.max("class_id").alias("last"))
    lines = lookup_join(encoder.select("task", F.col("class_id").alias("y_true")), sized, ["task"])
    others = [c for c in by if c != "task"]
    if others:
        cells = settle(cells, "cells")
        lines = cells.select(*by).distinct().join(lines, "task")
    # Lines meet their runs before they unfold, so the grid is never the side of a join that is sent around.
    grid = lines.select(
        *by, "y_true", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("y_pred")
    )
    keys = [*by, "y_true", "y_pred"]
    counts = cells.where(F.col("y_pred").isNotNull()).select(*keys, "n")
    return grid.join(counts, keys, "left").select(
        *keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_matrix_wide(
    matrix: DataFrame, classes: int, by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """One row per true class with columns ``pred_0 .. pred_<classes-1>``.

    Counts of a class outside them fail the job: they would be in no column.
    """
    known = F.col("n").isNull() | (F.col("n") == 0) | F.col("y_pred").isNull() | F.col("y_pred").between(0, classes - 1)
    told = F.concat(F.lit("predictions of an unknown class: "), F.col("y_pred").cast("string"))
    matrix = matrix.withColumn("n", F.when(known, F.col("n")).otherwise(F.raise_error(told).cast("bigint")))
    columns = [
        F.sum(F.when(F.col("y_pred") == c, F.col("n"))).alias(f"pred_{c}") for c in range(classes)
    ]
    return matrix.groupBy(*by, "y_true").agg(*columns)
