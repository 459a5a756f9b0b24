"""Confusion cells of a growing prediction table, kept per written batch.

Cells of two batches add up, so the metrics of all batches need the predictions of new ones only.  A batch's cells are written
first, under a name of their own, and then told in one line of the list of writes; only what the list names is read.  So a
write that failed leaves nothing to be seen, a repeated one replaces the earlier, and readers see a batch as
it was before or as it is after.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.operators.cells import DEFAULT_BY, confusion_cells
from tallyframe.storage import lookup_join, settle

_WRITES = "batch string, written bigint, token string, cells bigint, total bigint"


def create_cells(predictions: DataFrame, path: str, by: Sequence[str] = DEFAULT_BY) -> None:
    """An empty store for cells of predictions with these columns; ``path`` must be new."""
    spark = predictions.sparkSession
    empty = confusion_cells(predictions, by).where("false")
    empty.limit(0).write.parquet(f"{path}/layout")
    spark.createDataFrame([], _WRITES).write.parquet(f"{path}/writes")


def _layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/layout")


def _tell(spark: SparkSession, path: str, *rows: tuple) -> None:
    spark.createDataFrame(list(rows), _WRITES).coalesce(1).write.mode("append").parquet(f"{path}/writes")


def put_batch(predictions: DataFrame, path: str, batch: str) -> None:
    """Count the predictions of ``batch`` and put the counts in place of those it had, if any.

    Only ``predictions`` are read.  Of two writers of one batch the one that ends later wins.
    """
    spark = predictions.sparkSession
    layout = _layout(spark, path)
    by = [c for c in layout.columns if c not in ("y_true", "y_pred", "n")]
    token = uuid.uuid4().hex
    cells = confusion_cells(predictions, by).select(*(F.col(f.name).cast(f.dataType) for f in layout.schema.fields))
    cells.write.parquet(f"{path}/cells/token={token}")
    stored = spark.read.schema(layout.schema).parquet(f"{path}/cells/token={token}")
    cells_written, total = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    _tell(spark, path, (batch, time.time_ns(), token, cells_written, total))


def put_batches(predictions: DataFrame, path: str, column: str | Column, batches: Sequence[str]) -> None:
    """Count each of the named ``batches`` of a table; ``column`` tells the batch of a row.

    The table is read once, and only the named batches of it if ``column`` is a folder column.  All of them are seen at once.
    """
    spark = predictions.sparkSession
    layout = _layout(spark, path)
    by = [c for c in layout.columns if c not in ("y_true", "y_pred", "n")]
    batch = (F.col(column) if isinstance(column, str) else column).cast("string")
    chosen = predictions.where(batch.isin(list(batches))).withColumn("_batch", batch)
    # One folder holds the cells of all; the list names it with each batch.
    token = uuid.uuid4().hex
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in layout.schema.fields]
    confusion_cells(chosen, ["_batch", *by]).select("_batch", *typed).write.parquet(f"{path}/cells/token={token}")
    stored = spark.read.schema(f"_batch string, {_ddl(layout)}").parquet(f"{path}/cells/token={token}")
    found = {r[0]: r[1:] for r in stored.groupBy("_batch").agg(F.count("*"), F.sum("n")).collect()}
    now = time.time_ns()
    _tell(spark, path, *((b, now, token, *found.get(b, (0, 0))) for b in batches))


def _ddl(layout: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layout.schema.fields)


def remove_batch(spark: SparkSession, path: str, batch: str) -> None:
    """Take a batch out of the store."""
    _tell(spark, path, (batch, time.time_ns(), None, 0, 0))


def stored_batches(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, written, token, cells, total)``: the last write of every batch that is in the store."""
    writes = spark.read.schema(_WRITES).parquet(f"{path}/writes")
    last = Window.partitionBy("batch").orderBy(F.desc("written"), F.desc("token"))
    return writes.withColumn("place", F.row_number().over(last)).where("place = 1 AND token IS NOT NULL").drop("place")


def new_batches(batches: DataFrame, path: str) -> DataFrame:
    """Rows of ``batches`` (a column ``batch``) that the store does not have."""
    return batches.join(stored_batches(batches.sparkSession, path).select("batch"), "batch", "left_anti")


def stored_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all batches together: what ``confusion_cells`` gives for all their predictions."""
    layout = _layout(spark, path)
    current = stored_batches(spark, path)
    if not current.where("cells > 0").limit(1).count():
        return layout
    cells = spark.read.schema(f"_batch string, {_ddl(layout)}, token string").parquet(f"{path}/cells")
    live = lookup_join(cells, current.select("token", F.col("batch").alias("_live")), ["token"], "inner")
    keys = [c for c in layout.columns if c != "n"]
    mine = F.col("_batch").isNull() | (F.col("_batch") == F.col("_live"))
    return live.where(mine).groupBy(*keys).agg(F.sum("n").alias("n"))


def compact_cells(spark: SparkSession, path: str, into: str) -> None:
    """A new store at ``into`` with the same batches, the cells of all in one folder; old writes are left behind."""
    layout = _layout(spark, path)
    current = settle(stored_batches(spark, path), "current")
    layout.write.parquet(f"{into}/layout")
    token = uuid.uuid4().hex
    if current.where("cells > 0").limit(1).count():
        cells = spark.read.schema(f"_batch string, {_ddl(layout)}, token string").parquet(f"{path}/cells")
        live = cells.join(current.select("token", F.col("batch").alias("_live")), "token")
        mine = live.where(F.col("_batch").isNull() | (F.col("_batch") == F.col("_live")))
        mine.select(F.col("_live").alias("_batch"), *layout.columns).hint("rebalance", F.col("_batch")).write.parquet(f"{into}/cells/token={token}")
    current.withColumn("token", F.lit(token)).write.parquet(f"{into}/writes")
