import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import (
    argmax,
    confidence,
    cross_entropy,
    focal_term,
    log_softmax,
    softmax,
    symmetric_kl_term,
)
from tallyframe.operators.scoring import (
    HEADS_SCHEMA,
    centroid_heads,
    combine_losses,
    fit_heads,
    focal_loss,
    predict,
    regularised_loss,
    row_losses,
    score_heads,
    symmetric_kl,
)


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_softmax_is_stable_and_argmax_takes_the_first(table):
    df = table("a array<double>, b array<double>", ([1.0, 3.0, 3.0], [1000.0, -1000.0]))
    assert one(df, argmax(F.col("a"))) == 1
    assert one(df, softmax(F.col("b"))) == [1.0, 0.0]
    assert one(df, log_softmax(F.col("b"))) == [0.0, -2000.0]
    p = one(df, softmax(F.col("a")))
    assert sum(p) == pytest.approx(1.0) and one(df, confidence(softmax(F.col("a")))) == max(p)


def test_cross_entropy_matches_its_formula(table):
    logits, weights, y, eps = [0.3, -1.2, 2.0], [0.5, 2.0, 1.5], 1, 0.1
    df = table("z array<double>, w array<double>, y int", (logits, weights, y))
    lp = [z - math.log(sum(map(math.exp, logits))) for z in logits]
    plain = one(df, cross_entropy(log_softmax(F.col("z")), F.col("y")))
    assert plain == pytest.approx(-lp[y])
    full = one(df, cross_entropy(log_softmax(F.col("z")), F.col("y"), F.col("w"), eps))
    expected = (1 - eps) * weights[y] * -lp[y] + eps / 3 * sum(w * -v for w, v in zip(weights, lp))
    assert full == pytest.approx(expected)
    focal = one(df, focal_term(cross_entropy(log_softmax(F.col("z")), F.col("y")), 2.0))
    assert focal == pytest.approx((1 - math.exp(lp[y])) ** 2 * -lp[y])


def test_symmetric_kl_of_rows(table):
    a, b = [0.1, 0.9, -0.4], [1.0, 0.0, 0.5]
    df = table("a array<double>, b array<double>", (a, b))
    la, lb = (np.array(v) - np.log(np.exp(v).sum()) for v in (a, b))
    expected = ((np.exp(lb) * (lb - la)).sum() + (np.exp(la) * (la - lb)).sum()) / 2
    got = one(df, symmetric_kl_term(log_softmax(F.col("a")), log_softmax(F.col("b"))))
    assert got == pytest.approx(expected)
    assert one(df, symmetric_kl_term(log_softmax(F.col("a")), log_softmax(F.col("a")))) == 0.0


@pytest.fixture
def vectors(spark):
    generator = random.Random(3)
    data = [(i, [generator.gauss((i % 3) * 2.0, 1.0) for _ in range(5)], i % 3, i % 2) for i in range(90)]
    return spark.createDataFrame(data, "row_idx bigint, v array<double>, three int, two int")


def test_all_heads_are_scored_in_one_pass(spark, vectors):
    generator = random.Random(1)
    heads = [(t, c, [generator.random() for _ in range(5)], generator.random())
             for t, k in (("a", 3), ("b", 2)) for c in range(k)]
    frame = spark.createDataFrame(heads, HEADS_SCHEMA)
    scored = score_heads(vectors.repartition(5), "v", frame)
    got = {(r.row_idx, r.task): r.logits for r in scored.collect()}
    assert len(got) == 180
    for row in vectors.collect():
        for task in ("a", "b"):
            expected = [np.dot(w, row.v) + b for t, _, w, b in heads if t == task]
            assert got[(row.row_idx, task)] == pytest.approx(expected)


def test_heads_with_gaps_and_null_vectors(spark, table):
    gap = spark.createDataFrame([("a", 1, [1.0], 0.0)], HEADS_SCHEMA)
    rows = table("row_idx bigint, v array<double>", (1, [2.0]), (2, None))
    with pytest.raises(ValueError, match="class ids"):
        score_heads(rows, "v", gap)
    sound = spark.createDataFrame([("a", 0, [1.0], 0.5)], HEADS_SCHEMA)
    assert [(r.row_idx, r.logits) for r in score_heads(rows, "v", sound).collect()] == [(1, [2.5])]


def test_centroid_heads_pick_the_nearest_centre(vectors):
    heads = centroid_heads(vectors, "v", {"three": "three"})
    local = vectors.toPandas()
    centres = np.stack([np.stack(local.v[local.three == c]).mean(axis=0) for c in range(3)])
    got = {r.row_idx: r.y_pred for r in predict(score_heads(vectors, "v", heads)).collect()}
    for i, v in zip(local.row_idx, local.v):
        assert got[i] == int(np.argmin(((centres - v) ** 2).sum(axis=1)))


def test_losses_and_their_combination(table):
    scored = table("row_idx int, task string, logits array<double>, y_true int",
                   (1, "a", [1.0, 0.0], 0), (2, "a", [0.0, 1.0], 0), (1, "b", [0.0, 0.0], 1))
    weights = table("task string, weights array<double>", ("a", [2.0, 1.0]), ("b", [1.0, 3.0]))
    rows = {(r.task, r.row_idx): r for r in row_losses(scored, 2.0, weights).collect()}
    assert rows[("b", 1)].ce == pytest.approx(3 * math.log(2))
    assert rows[("a", 1)].ce == pytest.approx(2 * math.log(1 + math.exp(-1)))
    losses = focal_loss(scored, 2.0, weights)
    by_task = {r.task: r.loss for r in losses.collect()}
    assert by_task["a"] == pytest.approx((rows[("a", 1)].focal + rows[("a", 2)].focal) / 2)
    log_vars = table("task string, log_var double", ("a", 0.4))
    combined = combine_losses(losses, log_vars)
    assert combined.first().total_loss == pytest.approx(math.exp(-0.4) * by_task["a"] + 0.2 + by_task["b"])
    assert combine_losses(losses).first().total_loss == pytest.approx(sum(by_task.values()))
    other = scored.withColumn("logits", F.reverse("logits"))
    kl = symmetric_kl(scored, other)
    assert {r.task: r.n for r in kl.collect()} == {"a": 2, "b": 1}
    total = regularised_loss(combined, kl, 0.5).first().total_loss
    assert total == pytest.approx(combined.first().total_loss + 0.5 * sum(r.kl for r in kl.collect()))


def test_fitted_heads_separate_the_classes(vectors):
    heads = fit_heads(vectors, "v", {"three": "three"}, max_iter=30)
    predicted = predict(score_heads(vectors, "v", heads, ["row_idx", "three"]))
    right = predicted.where("y_pred = three").count()
    assert heads.count() == 3 and right >= 80
