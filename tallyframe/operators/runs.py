"""Comparing runs: seed aggregates, tables, leaderboards and training histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import interval_text, mean_std_text
from tallyframe.storage import settle


def aggregate_seeds(
    metrics: DataFrame,
    value: str = "macro_f1",
    by: Sequence[str] = ("prefix",),
    summary: str = "MEAN_MACRO_F1",
) -> DataFrame:
    """Mean, population std, min, max and n over the runs, per task and for the run means.

    Tasks some runs lack are aggregated over the runs that have them.
    """
    # The tasks of a run travel with its mean, so the metrics are computed once.
    runs = metrics.groupBy(*by, "run").agg(
        F.collect_list(F.struct("task", F.col(value).alias("value"))).alias("tasks"),
        F.struct(F.lit(summary).alias("task"), F.avg(value).alias("value")).alias("mean"),
    )
    values = runs.select(*by, F.explode(F.array_append("tasks", F.col("mean"))).alias("v")).select(
        *by, "v.task", F.col("v.value").alias(value)
    )
    return values.groupBy(*by, "task").agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("n"),
    )


def compare_settings(summary: DataFrame, first: str, second: str) -> DataFrame:
    """Two prefixes side by side with the difference of their means, one row per task."""

    def side(prefix: str, name: str):
        chosen = F.col("prefix") == prefix
        return [
            F.max(F.when(chosen, F.col("mean"))).alias(f"{name}_mean"),
            F.max(F.when(chosen, F.col("std"))).alias(f"{name}_std"),
        ]

    return (
        summary.where(F.col("prefix").isin(first, second))
        .groupBy("task")
        .agg(*side(first, "first"), *side(second, "second"))
        .withColumn("delta_mean", F.col("first_mean") - F.col("second_mean"))
    )


def comparison_text(comparison: DataFrame) -> DataFrame:
    return comparison.select(
        "task",
        mean_std_text(F.col("first_mean"), F.col("first_std")).alias("first"),
        mean_std_text(F.col("second_mean"), F.col("second_std")).alias("second"),
    )


def significance_text(table: DataFrame) -> DataFrame:
    """The published form of a significance table: intervals as text, figures rounded."""
    return table.select(
        "task",
        F.round("delta", 4).alias("delta"),
        interval_text(F.col("low"), F.col("high")).alias("ci95"),
        F.round("p_two_sided", 3).alias("paired_p"),
        interval_text(F.col("tost_low"), F.col("tost_high")).alias("ci90"),
        F.round("tost_p", 3).alias("tost_p"),
        "equivalent",
    )


def leaderboard(
    metrics: DataFrame, by: Sequence[str] = ("run",), reference: str | None = None
) -> DataFrame:
    """Runs ranked by mean macro F1 with the distance to the best (or a named) run.

    The windows run over one row per run.
    """
    means = metrics.groupBy(*by).agg(
        F.avg("macro_f1").alias("mean_macro_f1"), F.count("*").alias("tasks")
    )
    everything = Window.partitionBy()
    best = F.max("mean_macro_f1").over(everything)
    if reference is not None:
        best = F.max(F.when(F.col(by[0]) == reference, F.col("mean_macro_f1"))).over(everything)
    # Rounded, so that the order of float additions cannot part runs that tie.
    return means.select(
        F.rank().over(Window.orderBy(F.round("mean_macro_f1", 12).desc())).alias("place"),
        *by,
        "mean_macro_f1",
        "tasks",
        (F.col("mean_macro_f1") - best).alias("delta"),
    )


def missing_baselines(
    predictions: DataFrame, tasks: DataFrame, prefix: str, split: str | None = None
) -> DataFrame:
    """Tasks for which no prediction of the baseline prefix exists."""
    found = predictions.where(F.col("prefix") == prefix)
    if split is not None:
        found = found.where(F.col("split") == split)
    return tasks.select("task").distinct().join(
        found.select("task").distinct(), "task", "left_anti"
    )


def epoch_loss(batches: DataFrame) -> DataFrame:
    """Mean logged batch loss per run and epoch."""
    return batches.groupBy("run", "epoch").agg(
        F.avg("loss").alias("train_loss"), F.count("loss").alias("batches")
    )


def _without_nan(history: DataFrame, metric: str) -> DataFrame:
    return history.withColumn(metric, F.when(~F.isnan(metric), F.col(metric)))


def best_epoch(history: DataFrame, metric: str = "val_mean_f1") -> DataFrame:
    """The first epoch that reaches each run's highest value (it must exceed 0; NaN never counts)."""
    history = _without_nan(history, metric)
    top = F.max(F.struct(F.col(metric).alias("value"), (-F.col("epoch")).alias("back")))
    return (
        history.where(F.col(metric) > 0)
        .groupBy("run")
        .agg(top.alias("top"))
        .select("run", (-F.col("top.back")).alias("best_epoch"), F.col("top.value").alias("best"))
    )


def early_stopping(
    history: DataFrame, patience: int = 5, metric: str = "val_mean_f1"
) -> DataFrame:
    """Replay the stopping rule: each epoch's running best, patience used and stop mark.

    An epoch improves when it beats every earlier one (and 0); training stops at
    the first epoch that is ``patience`` epochs past the last improvement.  NaN is
    no improvement and shows as null.  The windows run over the epochs of one run.
    """
    history = _without_nan(history, metric)
    order = Window.partitionBy("run").orderBy("epoch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.col(metric)
    improved = value > F.greatest(F.coalesce(F.max(value).over(before), F.lit(0.0)), F.lit(0.0))
    steps = history.select(
        "run",
        "epoch",
        value.alias("value"),
        F.row_number().over(order).alias("step"),
        F.coalesce(improved, F.lit(False)).alias("improved"),
    )
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("step"))).over(upto), F.lit(0))
    # A stop is permanent, so the first time the patience runs out is the stop.
    waited = steps.withColumn("waited", (F.col("step") - last).cast("int"))
    out = F.col("waited") >= patience
    return waited.select(
        "run",
        "epoch",
        "value",
        "improved",
        F.max("value").over(upto).alias("best_so_far"),
        "waited",
        (out & (F.count(F.when(out, 1)).over(upto) == 1)).alias("stop"),
    )


def stopping_summary(
    history: DataFrame, patience: int = 5, metric: str = "val_mean_f1"
) -> DataFrame:
    """Per run: where it stops (null when it never does) and its best epoch up to there."""
    steps = early_stopping(history, patience, metric)
    stop = F.min(F.when(F.col("stop"), F.col("epoch"))).over(Window.partitionBy("run"))
    kept = steps.withColumn("stop_epoch", stop).where(
        F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))
    )
    return kept.groupBy("run").agg(
        F.max("stop_epoch").alias("stop_epoch"),
        F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
        F.max("value").alias("best"),
    )


def cost_ratios(
    costs: DataFrame, reference: str, figures: Sequence[str], key: str = "setup"
) -> DataFrame:
    """Each setup's costs divided by those of the reference setup.

    The reference figures are scalars to the plan, so nothing is joined.
    """
    known = settle(costs.select(key, *figures), "costs")
    base = known.where(F.col(key) == reference)
    return known.select(
        key,
        *figures,
        *(
            F.try_divide(F.col(c), base.select(F.max(c)).scalar()).alias(f"{c}_ratio")
            for c in figures
        ),
    )
