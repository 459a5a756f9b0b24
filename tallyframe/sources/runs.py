"""Run artifacts: predictions, metrics, histories and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import run_prefix, run_seed

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("seed", T.IntegerType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("task", T.StringType()),
        T.StructField("y_true", T.IntegerType()),
        T.StructField("y_pred", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

# Figures of a task in a metrics file; the two known layouts each have some of them.
_FIGURES = {
    "macro_f1": "double", "accuracy": "double", "weighted_f1": "double", "per_class_f1": "array<double>",
}


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Parquet in (prefix, run, split) folders, so readers open only what they compare.

    Writing a run's split again replaces it and leaves all others.  Rows are dealt by folder and rebalanced by
    size: small folders have one file, and a large run is split into as many tasks as its bytes ask for.
    """
    names = [f.name for f in PREDICTION_SCHEMA.fields]
    missing = [c for c in names if c not in predictions.columns]
    if missing:
        raise ValueError(f"columns not in the predictions: {missing}")
    folders = ("prefix", "run", "split")
    dealt = predictions.select(*names).hint("rebalance", *map(F.col, folders))
    dealt.write.partitionBy(*folders).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_predictions(
    spark: SparkSession,
    path: str,
    prefix: str | None = None,
    split: str | None = None,
    tasks: Sequence[str] | None = None,
    runs: Sequence[str] | None = None,
) -> DataFrame:
    """The prediction table, pruned by folder on prefix, run and split.

    Tasks a run did not answer are simply not there.
    """
    found = spark.read.schema(PREDICTION_SCHEMA).parquet(path)
    for column, value in (("prefix", prefix), ("split", split)):
        if value is not None:
            found = found.where(F.col(column) == value)
    for column, values in (("run", runs), ("task", tasks)):
        if values is not None:
            found = found.where(F.col(column).isin(list(values)))
    return found


def missing_tasks(found: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Wanted tasks that the scan did not find."""
    spark = found.sparkSession
    wanted = spark.createDataFrame([(t,) for t in tasks], "task string")
    return wanted.join(found.select("task").distinct(), "task", "left_anti")


def write_run_metrics(metrics: DataFrame, path: str) -> None:
    """Nested JSON per run and split: ``{task: {...}, "mean_macro_f1": x}``.

    ``metrics`` has one row per (run, split, task); each line of the result is the
    object of one run, in that run's own folder.
    """
    figures = F.struct(*(c for c in _FIGURES if c in metrics.columns))
    entry = F.struct("task", F.to_variant_object(figures))
    whole = F.map_concat(
        F.map_from_entries(F.collect_list(entry)),
        F.create_map(
            F.lit("mean_macro_f1"), F.avg("macro_f1").cast("variant"),
            F.lit("split"), F.first("split").cast("variant"),
        ),
    )
    lines = metrics.groupBy("run", "split").agg(whole.alias("whole"))
    lines.select("run", "split", F.to_json("whole").alias("value")).write.partitionBy(
        "run", "split"
    ).text(path)


def read_runs(
    spark: SparkSession, path: str, split: str, prefix: str | None = None
) -> DataFrame:
    """Task metrics of many runs: ``(run, prefix, seed, split, task, ...)``.

    Reads flat files named ``<run>_<split>_results.json`` and the per-run folders
    of ``write_run_metrics``; both metric layouts (with per-class lists, or with
    weighted F1) have the same columns, absent figures null.  ``prefix`` is
    compared with the whole prefix, so ``exp_1`` does not take in ``exp_10``.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    flat = rf"([^/]+)_{split}_results\.json$"
    nested = rf"/run=([^/]+)/split={split}/[^/]*$"
    run = F.when(name.rlike(flat), F.regexp_extract(name, flat, 1)).when(
        name.rlike(nested), F.regexp_extract(name, nested, 1)
    )
    chosen = files.select(F.url_decode(run).alias("run"), "value").where(F.col("run").isNotNull())
    if prefix is not None:
        chosen = chosen.where(run_prefix(F.col("run")) == prefix)
    fields = F.explode(F.parse_json("value").cast("map<string, variant>")).alias("task", "body")
    return (
        chosen.select("run", fields)
        .where(F.schema_of_variant("body").startswith("OBJECT"))
        .select(
            "run",
            run_prefix(F.col("run")).alias("prefix"),
            run_seed(F.col("run")).alias("seed"),
            F.lit(split).alias("split"),
            "task",
            *(F.try_variant_get("body", f"$.{c}", t).alias(c) for c, t in _FIGURES.items()),
        )
    )


def read_history(spark: SparkSession, path: str, tasks: Sequence[str]) -> DataFrame:
    """Training histories ``<run>_history.csv``, one row per run and epoch."""
    schema = T.StructType(
        [
            T.StructField("epoch", T.IntegerType()),
            T.StructField("train_loss", T.DoubleType()),
            T.StructField("val_mean_f1", T.DoubleType()),
            *(T.StructField(f"{t}_f1", T.DoubleType()) for t in tasks),
        ]
    )
    found = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    run = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_history\.csv", 1))
    return found.select(run.alias("run"), *schema.names)


def history_long(history: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """One row per run, epoch and task."""
    columns = [f"{t}_f1" for t in tasks]
    long = history.unpivot(["run", "epoch"], columns, "task", "f1")
    return long.withColumn("task", F.regexp_replace("task", "_f1$", ""))


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)
