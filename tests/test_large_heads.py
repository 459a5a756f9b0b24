import pytest
from pyspark.sql import functions as F

from tallyframe.operators.large_heads import predict_blocks
from tallyframe.operators.scoring import predict, row_losses, score_heads

HEADS = "task string, class_id int, weight array<double>, bias double"


def some_heads(spark, sizes, width=3):
    rows = [(t, c, [((c * 7 + k * 3 + len(t)) % 11 - 5) / 3 for k in range(width)], (c % 4) / 5) for t, n in sizes.items() for c in range(n)]
    return spark.createDataFrame(rows, HEADS)


def some_rows(spark):
    rows = [(i, [((i * (k + 2)) % 13 - 6) / 4 for k in range(3)], i % 9, None if i % 5 == 0 else i % 2) for i in range(40)]
    return spark.createDataFrame([*rows, (40, None, 1, 1)], "row_idx long, v array<double>, task int, b int")


@pytest.mark.parametrize("parameters", [1, 12, 20, 1 << 20])
def test_blocks_predict_like_all_logits(spark, parameters):
    heads, rows = some_heads(spark, {"a": 9, "bb": 2, "c": 1}), some_rows(spark)
    got = {(r.row_idx, r["_t"]): r for r in predict_blocks(rows, "v", heads, ["row_idx"], {"a": "task", "bb": "b"}, parameters).withColumnRenamed("task", "_t").collect()}
    truth = F.when(F.col("t") == "a", F.col("y")).when(F.col("t") == "bb", F.col("b"))
    small = score_heads(rows.withColumnRenamed("task", "y"), "v", heads, ["row_idx", "y", "b"]).withColumnRenamed("task", "t").withColumn("y_true", truth)
    want = row_losses(predict(small)).collect()
    assert len(got) == len(want) == 120
    for r in want:
        g = got[r.row_idx, r.t]
        assert g.y_pred == r.y_pred and g.confidence == pytest.approx(r.confidence)
        assert g.ce is None if r.y_true is None else g.ce == pytest.approx(r.ce)


def test_three_hundred_thousand_classes(spark):
    n = 300_000
    heads = spark.range(n).select(
        F.lit("t").alias("task"), F.col("id").cast("int").alias("class_id"),
        F.array(F.col("id") / n, 1 - F.col("id") / n).alias("weight"), (-(F.col("id") / n) ** 2).alias("bias"),
    )
    rows = spark.createDataFrame([(i, [i / 10, 0.0]) for i in range(11)], "row_idx long, v array<double>")
    # x w - w^2 is largest at w = x / 2.
    got = {r.row_idx: r for r in predict_blocks(rows, "v", heads, block_parameters=3 << 15).collect()}
    assert {i: r.y_pred for i, r in got.items()} == {i: n * i // 20 for i in range(11)}
    assert all(1 / n < r.confidence < 2 / n for r in got.values())


def test_odd_heads(spark):
    rows = some_rows(spark)
    assert predict_blocks(rows, "v", spark.createDataFrame([], HEADS)).count() == 0
    assert predict_blocks(rows.limit(0), "v", some_heads(spark, {"a": 2})).count() == 0
    with pytest.raises(ValueError, match="class ids"):
        predict_blocks(rows, "v", some_heads(spark, {"a": 3}).where("class_id <> 1"))
    with pytest.raises(ValueError, match="lengths"):
        predict_blocks(rows, "v", some_heads(spark, {"a": 3}).unionByName(some_heads(spark, {"b": 1}, 2)))
