"""Label preparation: cleaning, encoding, class counts, imbalance and class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import map_flag, strip_space
from tallyframe.storage import lookup_join, settle


def normalise_labels(
    df: DataFrame, tasks: Sequence[str], keep_missing_as: str | None = None
) -> DataFrame:
    """Strip Unicode white space from every label column.

    Missing labels stay null, so ``drop_incomplete`` removes them; give
    ``keep_missing_as`` to turn them into a class of that name instead.
    """

    def clean(task: str):
        label = strip_space(F.col(task))
        return label if keep_missing_as is None else F.coalesce(label, F.lit(keep_missing_as))

    return df.withColumns({task: clean(task) for task in tasks})


def map_labels(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the values of a flag column, e.g. ``TRUE``/``FALSE`` to class names."""
    return df.withColumn(column, map_flag(F.col(column), mapping))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def unpivot_labels(df: DataFrame, ids: Sequence[str], tasks: Sequence[str]) -> DataFrame:
    """Wide label columns to one row per (row, task)."""
    texts = [F.col(task).cast("string").alias(task) for task in tasks]
    return df.select(*ids, *texts).unpivot(list(ids), list(tasks), "task", "label")


def fit_encoder(labels: DataFrame) -> DataFrame:
    """Class ids 0..k-1 per task in sorted label order.

    The window runs over the distinct (task, label) pairs only: one row per class.
    """
    classes = labels.where(F.col("label").isNotNull()).select("task", "label").distinct()
    order = Window.partitionBy("task").orderBy("label")
    encoder = classes.select(
        "task",
        (F.row_number().over(order) - 1).alias("class_id"),
        F.col("label").alias("class_name"),
    )
    return settle(encoder, "encoder")


def encode(labels: DataFrame, encoder: DataFrame) -> DataFrame:
    """Add ``class_id`` to long labels; labels the encoder lacks get null."""
    names = encoder.select("task", F.col("class_name").alias("label"), "class_id")
    return lookup_join(labels, names, ["task", "label"])


def encode_wide(
    df: DataFrame, encoder: DataFrame, tasks: Sequence[str], suffix: str = "_encoded"
) -> DataFrame:
    """One ``<task>_encoded`` column per task; one small lookup each, no unpivot."""
    known = settle(encoder, "encoder")
    out = df
    for task in tasks:
        ids = known.where(F.col("task") == task).select(
            F.col("class_name").alias(task), F.col("class_id").alias(f"{task}{suffix}")
        )
        out = out.join(ids, task, "left")
    return out.select(*df.columns, *(f"{task}{suffix}" for task in tasks))


def decode(
    df: DataFrame, encoder: DataFrame, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Replace class ids by names: ``{id column: name column}``, true and predicted by default."""
    columns = columns or {"y_true": "true_label", "y_pred": "pred_label"}
    known = settle(encoder, "encoder")
    out = df
    for source, target in columns.items():
        names = known.select(
            "task", F.col("class_id").alias(source), F.col("class_name").alias(target)
        )
        out = out.join(names, ["task", source], "left")
    return out.select(*df.columns, *columns.values())


def num_classes(encoder: DataFrame, tasks: Sequence[str] | None = None) -> DataFrame:
    chosen = encoder if tasks is None else encoder.where(F.col("task").isin(list(tasks)))
    return chosen.groupBy("task").agg(F.count("*").alias("num_classes"))


def class_counts(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class.  Nulls are not a class."""
    return (
        labels.where(F.col("label").isNotNull())
        .groupBy(*by, "task", "label")
        .agg(F.count("*").alias("n"))
    )


def imbalance_report(labels: DataFrame) -> DataFrame:
    """Rarest and commonest class per task, their ratio and a warning level."""
    per_task = (
        class_counts(labels)
        .groupBy("task")
        .agg(
            F.min(F.struct("n", "label")).alias("rarest"),
            F.max("n").alias("max_count"),
        )
    )
    ratio = F.col("max_count") / F.col("rarest.n")
    return per_task.select(
        "task",
        F.col("rarest.label").alias("min_class"),
        F.col("rarest.n").alias("min_count"),
        "max_count",
        ratio.alias("ratio"),
        F.when(ratio > 20, "SEVERE").when(ratio > 5, "MODERATE").otherwise("").alias("flag"),
    )


def class_weights(labels: DataFrame, cap: float = 10.0) -> DataFrame:
    """Balanced weight ``n / (k * count)`` per class, clipped to ``[1/cap, cap]``.

    ``k`` counts the classes that occur.  The windows run over one row per class.
    """
    task = Window.partitionBy("task")
    raw = F.sum("n").over(task) / (F.count("*").over(task) * F.col("n"))
    clipped = F.least(F.greatest(raw, F.lit(1.0 / cap)), F.lit(float(cap)))
    return class_counts(labels).select("task", "label", "n", clipped.alias("weight"))
