"""Per-class and per-task metrics from confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.cells import DEFAULT_BY, confusion_cells
from tallyframe.operators.labels import num_classes
from tallyframe.storage import lookup_join, settle


def _ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def per_class(cells: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """Precision, recall and F1 of each class seen in truth or predictions.

    A cell adds to two classes, its true one and its predicted one; unfolding it
    gives row sums, column sums and hits in a single aggregate, with no join.
    """
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    as_true = F.struct(
        F.col("y_true").alias("class"),
        F.col("n").alias("support"),
        none.alias("predicted"),
        hit.alias("tp"),
    )
    as_predicted = F.struct(
        F.col("y_pred").alias("class"),
        none.alias("support"),
        F.col("n").alias("predicted"),
        none.alias("tp"),
    )
    counts = (
        cells.select(*by, F.explode(F.array(as_true, as_predicted)).alias("part"))
        .select(*by, "part.*")
        .where(F.col("class").isNotNull())
        .groupBy(*by, "class")
        .agg(*(F.sum(c).alias(c) for c in ("tp", "support", "predicted")))
    )
    return counts.withColumns(
        {
            "precision": _ratio_or_zero(F.col("tp"), F.col("predicted")),
            "recall": _ratio_or_zero(F.col("tp"), F.col("support")),
            "f1": _ratio_or_zero(F.col("tp") * 2, F.col("support") + F.col("predicted")),
        }
    )


def _accuracy() -> Column:
    return _ratio_or_zero(F.sum("tp"), F.sum("support"))


def _weighted(column: str) -> Column:
    return _ratio_or_zero(F.sum(F.col(column) * F.col("support")), F.sum("support"))


def accuracy(cells: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg(_ratio_or_zero(right, F.sum("n")).alias("accuracy"))


def macro_f1(
    cells: DataFrame, by: Sequence[str] = DEFAULT_BY, encoder: DataFrame | None = None
) -> DataFrame:
    """Unweighted mean F1 over the classes present in truth or predictions.

    With an ``encoder`` the mean is over all its classes, absent ones counting 0.
    """
    scores = per_class(cells, by)
    if encoder is None:
        return scores.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    sized = lookup_join(
        scores.groupBy(*by).agg(F.sum("f1").alias("total")), num_classes(encoder), ["task"]
    )
    return sized.select(*by, (F.col("total") / F.col("num_classes")).alias("macro_f1"))


def weighted_f1(cells: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    return per_class(cells, by).groupBy(*by).agg(_weighted("f1").alias("weighted_f1"))


def task_metrics(cells: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """All task-level figures in one aggregate, with the per-class F1 list in class order."""
    ordered = F.array_sort(F.collect_list(F.struct("class", "f1")))
    return (
        per_class(cells, by)
        .groupBy(*by)
        .agg(
            F.sum("support").alias("n"),
            (F.sum("support") - F.sum("tp")).alias("errors"),
            _accuracy().alias("accuracy"),
            F.avg("f1").alias("macro_f1"),
            _weighted("f1").alias("weighted_f1"),
            F.transform(ordered, lambda s: s["f1"]).alias("per_class_f1"),
        )
    )


def mean_macro_f1(metrics: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Mean of the task values; tasks count equally whatever their size."""
    return metrics.groupBy(*by).agg(F.avg("macro_f1").alias("mean_macro_f1"))


def classification_report(
    cells: DataFrame, encoder: DataFrame, by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """Class rows of the whole encoder plus accuracy, macro and weighted averages.

    A class of the data that the encoder lacks has a row too, with its number as label.

    The accuracy row repeats its value in every column, as report files do.
    Averages cover the classes present in the data.
    """
    scores = settle(per_class(cells, by), "per-class")
    names = encoder.select("task", F.col("class_id").alias("class"), "class_name")
    grid = scores.select(*by).distinct().join(names, "task")
    figures = ("precision", "recall", "f1", "support")
    class_rows = grid.join(scores, [*by, "class"], "full").select(
        *by,
        F.col("class").alias("position"),
        F.coalesce("class_name", F.col("class").cast("string")).alias("label"),
        *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in figures),
    )
    rows = F.array(
        F.struct(
            F.lit(1_000_000_000).alias("position"),
            F.lit("accuracy").alias("label"),
            *(F.col("accuracy").alias(c) for c in figures),
        ),
        F.struct(
            F.lit(1_000_000_001).alias("position"),
            F.lit("macro avg").alias("label"),
            *(F.col(f"macro_{c}").alias(c) for c in figures[:3]),
            F.col("total").alias("support"),
        ),
        F.struct(
            F.lit(1_000_000_002).alias("position"),
            F.lit("weighted avg").alias("label"),
            *(F.col(f"weighted_{c}").alias(c) for c in figures[:3]),
            F.col("total").alias("support"),
        ),
    )
    summary_rows = (
        scores.groupBy(*by)
        .agg(
            _accuracy().alias("accuracy"),
            *(F.avg(c).alias(f"macro_{c}") for c in figures[:3]),
            *(_weighted(c).alias(f"weighted_{c}") for c in figures[:3]),
            F.sum("support").cast("double").alias("total"),
        )
        .select(*by, F.explode(rows).alias("row"))
        .select(*by, "row.*")
    )
    return class_rows.unionByName(summary_rows)


def evaluate(
    predictions: DataFrame, by: Sequence[str] = DEFAULT_BY, summary: str = "MEAN"
) -> DataFrame:
    """Task metrics of every run plus one row holding the mean over its tasks.

    One scan and one combined aggregate of the predictions; the rest works on
    counts.  The summary row is the mean of task values, not a roll-up.
    """
    group = [c for c in by if c != "task"]
    figures = ("n", "errors", "accuracy", "macro_f1", "weighted_f1")
    # The tasks of a run travel with its mean, so nothing is computed twice.
    runs = (
        task_metrics(confusion_cells(predictions, by), by)
        .groupBy(*group)
        .agg(
            F.collect_list(F.struct("task", *figures)).alias("tasks"),
            F.struct(
                F.lit(summary).alias("task"),
                *(F.sum(c).alias(c) for c in figures[:2]),
                *(F.avg(c).alias(c) for c in figures[2:]),
            ).alias("mean"),
        )
        .where(F.size("tasks") > 0)
    )
    return runs.select(
        *group, F.explode(F.array_append("tasks", F.col("mean"))).alias("row")
    ).select(*group, "row.*")
