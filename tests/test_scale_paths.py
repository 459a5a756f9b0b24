"""The ways taken when a small side is not small, or a group is not small."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import resample
from tallyframe.operators.errors import first_errors
from tallyframe.operators.labels import decode, encode, fit_encoder
from tallyframe.operators.splits import stratified_split


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def hot_labels(spark, rows):
    """One label holds a third of the rows."""
    label = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50))
    return spark.range(rows).select(
        F.col("id").alias("row_idx"), F.lit("t").alias("task"), label.alias("label")
    )


def test_lookups_without_broadcast_give_the_same_rows(spark, no_broadcast):
    long = hot_labels(spark, 3000)
    encoder = fit_encoder(long)
    ids = encode(long, encoder)
    assert "BroadcastHashJoin" not in ids._jdf.queryExecution().executedPlan().toString()
    back = decode(ids, encoder, {"class_id": "name"})
    assert back.count() == 3000 and back.where("name = label").count() == 3000


def test_split_without_broadcast_is_the_same_split(spark, no_broadcast):
    df = hot_labels(spark, 3000).drop("task")
    joined = stratified_split(df, "row_idx", "label").select("row_idx", "split")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    sent = stratified_split(df, "row_idx", "label").select("row_idx", "split")
    assert joined.exceptAll(sent).count() == 0 and joined.count() == 3000


def test_draws_without_broadcast_are_the_same_draws(spark, monkeypatch):
    rows = spark.range(400).select(
        F.lit("r").alias("run"), F.lit("t").alias("task"), F.col("id").alias("row_idx"),
        (F.col("id") % 3).cast("int").alias("y_true"), (F.col("id") % 4).cast("int").alias("y_pred"),
    )
    sent = resample.replicate_scores(rows, ["t"], ["r"], 10, 1, "hash").orderBy("b").collect()
    monkeypatch.setattr(resample, "_BROADCAST_BYTES", 0)
    scores = resample.replicate_scores(rows, ["t"], ["r"], 10, 1, "hash")
    assert "SortMergeJoin" in scores._jdf.queryExecution().executedPlan().toString()
    assert scores.orderBy("b").collect() == sent


def test_long_error_lists_of_one_hot_group(spark):
    rows = spark.range(9000).select(
        F.lit("r").alias("run"), F.lit("t").alias("task"), F.col("id").alias("row_idx"),
        F.lit(0).alias("y_true"), F.lit(1).alias("y_pred"),
    )
    found = first_errors(rows, 2500)
    assert found.count() == 2500
    assert found.agg(F.max("row_idx"), F.max("place")).first()[:] == (2499, 2500)
