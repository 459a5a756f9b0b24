"""Label encoders as JSON: ``{task: {"classes": [...], "num_classes": k}}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "map<string, struct<classes: array<string>, num_classes: int>>"


def write_encoder(encoder: DataFrame, path: str) -> None:
    """One JSON object holding every task; one row per class goes in."""
    ordered = F.array_sort(F.collect_list(F.struct("class_id", "class_name")))
    per_task = encoder.groupBy("task").agg(
        F.struct(
            F.transform(ordered, lambda s: s["class_name"]).alias("classes"),
            F.count("*").cast("int").alias("num_classes"),
        ).alias("entry")
    )
    whole = per_task.agg(F.map_from_entries(F.collect_list(F.struct("task", "entry"))).alias("m"))
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)


def read_encoder(spark: SparkSession, path: str) -> DataFrame:
    """``(task, class_id, class_name)`` from one encoder file or folder."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", _ENTRY)).alias("task", "entry"))
    return entries.select("task", F.posexplode("entry.classes").alias("class_id", "class_name"))
