"""Prediction tables derived from the driver tables.

The driver tables hold labels but no model output, so predictions are derived
row by row with a keyed hash that any SQL engine can repeat: a run of quality
``p`` answers right in ``p`` per cent of the rows, picks another class
otherwise, and abstains (null) in one row out of 256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import hash60

SEEDS = (42, 123, 456, 789, 2024)
QUALITY = {"multi": 85, "single": 82}
RUNS = [(f"{p}_seed{s}", p, s, q) for p, q in QUALITY.items() for s in SEEDS]
MULTI = [r[0] for r in RUNS if r[1] == "multi"]
SINGLE = [r[0] for r in RUNS if r[1] == "single"]

LANGS = ("de", "en", "es", "fr")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input of few files; an input with enough splits is left alone.

    Every row is about to unfold into one row per task and run, so the narrow
    input is the cheap place to do it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _task(name: str, classes: int, truth: Column) -> Column:
    return F.struct(
        F.lit(name).alias("task"), F.lit(classes).alias("k"), truth.cast("int").alias("y_true")
    )


def _position(values: tuple[str, ...], column: str) -> Column:
    return F.array_position(F.array(*(F.lit(v) for v in values)), F.col(column)) - 1


def _truth(df: DataFrame, key: str, *tasks: Column) -> DataFrame:
    rows = df.select(F.col(key).alias("row_idx"), F.array(*tasks).alias("tasks"))
    return spread(rows, "row_idx").select("row_idx", F.explode("tasks").alias("t")).select(
        "row_idx", "t.*"
    )


def order_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(
        table(spark, sf_dir, "orders"),
        "o_orderkey",
        _task("priority", 5, F.substring("o_orderpriority", 1, 1).cast("int") - 1),
        _task("status", 3, F.instr(F.lit("FOP"), F.col("o_orderstatus")) - 1),
    )


def event_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(
        table(spark, sf_dir, "events"),
        "event_id",
        _task("event", 5, _position(EVENT_TYPES, "event_type")),
    )


def document_truth(spark: SparkSession, sf_dir: str, joint: bool = False) -> DataFrame:
    tasks = [_task("lang", 4, _position(LANGS, "lang"))]
    if joint:
        tasks.append(_task("half", 2, F.substring("source", 4, 3).cast("int") % 2))
    return _truth(table(spark, sf_dir, "documents"), "doc_id", *tasks)


def with_predictions(truth: DataFrame, prefixes: tuple[str, ...] = ("multi", "single")) -> DataFrame:
    runs = F.array(
        *(
            F.struct(
                F.lit(run).alias("run"),
                F.lit(prefix).alias("prefix"),
                F.lit(seed).alias("seed"),
                F.lit(quality).alias("quality"),
            )
            for run, prefix, seed, quality in RUNS
            if prefix in prefixes
        )
    )
    mixed = (
        truth.select("*", F.explode(runs).alias("r"))
        .select("row_idx", "task", "k", "y_true", "r.*")
        .withColumn("h", hash60("", F.col("run"), F.col("task"), F.col("row_idx").cast("string")))
    )

    def bits(shift: int, width: int) -> Column:
        return F.shiftright("h", shift).bitwiseAND((1 << width) - 1)

    other = (F.col("y_true") + 1 + bits(24, 16) % (F.col("k") - 1)) % F.col("k")
    answer = (
        F.when(bits(0, 8) == 0, F.lit(None).cast("int"))
        .when(bits(40, 20) % 100 < F.col("quality"), F.col("y_true"))
        .otherwise(other.cast("int"))
    )
    return mixed.select(
        "run", "prefix", "seed", F.lit("test").alias("split"), "row_idx", "task", "y_true",
        answer.alias("y_pred"),
        (bits(8, 16) % 10000 / F.lit(10000.0)).alias("confidence"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event means per type and day stand for a metric per run and epoch."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.round(F.avg("value") / 100.0, 9).alias("val_mean_f1"))
    )
