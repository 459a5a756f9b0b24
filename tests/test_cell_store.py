"""Metrics of a grown table from its batches are those of the whole table."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import cells, metrics
from tallyframe.sources import cell_store as store
from tallyframe.storage import fresh_path

BY = ["run", "task"]


@pytest.fixture
def predictions(spark):
    h = F.xxhash64("id")
    return spark.range(6000).select(
        F.concat(F.lit("b"), F.col("id") % 4).alias("batch"), F.concat(F.lit("r"), F.pmod(h, F.lit(3))).alias("run"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("task"),
        F.when(F.col("id") % 97 != 0, F.pmod(F.col("id"), F.lit(5)).cast("int")).alias("y_true"),
        F.when(F.col("id") % 31 != 0, F.pmod(F.shiftright(h, 8), F.lit(5)).cast("int")).alias("y_pred"),
    )


def rows(df):
    return sorted(map(str, df.select("run", "task", "y_true", "y_pred", "n").collect()))


def recounted(predictions, *batches):
    return rows(cells.confusion_cells(predictions.where(F.col("batch").isin(list(batches))), BY))


@pytest.fixture
def path(spark, predictions):
    path = fresh_path(spark, "store")
    store.create_cells(predictions, path, BY)
    return path


def part(predictions, batch):
    return predictions.where(F.col("batch") == batch)


def test_append_replace_remove(spark, predictions, path):
    assert store.stored_cells(spark, path).count() == 0
    store.put_batch(part(predictions, "b0"), path, "b0")
    assert rows(store.stored_cells(spark, path)) == recounted(predictions, "b0")
    store.put_batches(predictions, path, "batch", ["b1", "b2", "absent"])
    assert rows(store.stored_cells(spark, path)) == recounted(predictions, "b0", "b1", "b2")
    # A batch is replaced by other rows, and by its own again.
    store.put_batch(part(predictions, "b3"), path, "b1")
    assert rows(store.stored_cells(spark, path)) == recounted(predictions, "b0", "b2", "b3")
    store.put_batches(predictions, path, F.col("batch"), ["b1"])
    store.put_batches(predictions, path, "batch", ["b1"])
    assert rows(store.stored_cells(spark, path)) == recounted(predictions, "b0", "b1", "b2")
    store.remove_batch(spark, path, "b2")
    assert rows(store.stored_cells(spark, path)) == recounted(predictions, "b0", "b1")
    known = spark.createDataFrame([("b0",), ("b2",), ("b3",)], "batch string")
    assert sorted(r.batch for r in store.new_batches(known, path).collect()) == ["b2", "b3"]
    small = fresh_path(spark, "compact")
    store.compact_cells(spark, path, small)
    assert rows(store.stored_cells(spark, small)) == recounted(predictions, "b0", "b1")
    store.remove_batch(spark, small, "b0")
    assert rows(store.stored_cells(spark, small)) == recounted(predictions, "b1")
    got = metrics.task_metrics(store.stored_cells(spark, path), BY)
    want = metrics.task_metrics(cells.confusion_cells(predictions.where("batch in ('b0', 'b1')"), BY), BY)
    figures = [*BY, "n", "errors", "accuracy", F.round("macro_f1", 12), F.round("weighted_f1", 12)]
    assert sorted(map(str, got.select(*figures).collect())) == sorted(map(str, want.select(*figures).collect()))


def test_a_failed_write_leaves_the_batch_as_it_was(spark, predictions, path):
    store.put_batch(part(predictions, "b0"), path, "b0")
    broken = part(predictions, "b1").withColumn("y_pred", F.when(F.col("run") == "r1", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("y_pred")))
    with pytest.raises(Exception, match="lost"):
        store.put_batch(broken, path, "b0")
    # What a writer left that was lost before its line was written.
    lost = spark.createDataFrame([("r0", "x", 1, 1, 999)], "run string, task string, y_true int, y_pred int, n bigint")
    lost.write.parquet(f"{path}/cells/token=orphan")
    assert rows(store.stored_cells(spark, path)) == recounted(predictions, "b0")
    store.put_batch(part(predictions, "b1"), path, "b0")
    assert rows(store.stored_cells(spark, path)) == recounted(predictions, "b1")


def test_new_batches_read_only_their_folders(spark, predictions, path):
    stored = fresh_path(spark, "by-batch")
    predictions.write.partitionBy("batch").parquet(stored)
    table = spark.read.parquet(stored)
    plan = table.where(F.col("batch").cast("string").isin(["b3"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan
    store.put_batches(table, path, "batch", ["b3"])
    assert rows(store.stored_cells(spark, path)) == recounted(predictions, "b3")


def test_empty_batch_and_null_batch_name(spark, predictions, path):
    store.put_batch(predictions.where("false"), path, "none")
    assert store.stored_cells(spark, path).count() == 0
    assert [r.batch for r in store.stored_batches(spark, path).collect()] == ["none"]
