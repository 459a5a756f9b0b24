import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators.scoring import fit_heads, focal_loss, score_heads
from tallyframe.operators.training import (
    Heads, Objective, batch_gradient, divergence_gradient, dropped, focal_gradient, gradient, prepare_rows, train_heads, zero_heads,
)

GOALS = [Objective(), Objective(2.0, 0.1, uncertainty=False), Objective(0.0), Objective(5.0, 0.1, 0.7, 0.3), Objective(1.5, 0.0, 2.0, 0.1, False)]


def some_rows(n=60, width=4, seed=0):
    spin = np.random.default_rng(seed)
    vectors = spin.normal(size=(n, width))
    first = vectors[:, :3].argmax(axis=1)
    second = (vectors.sum(axis=1) > 0.5).astype(int)
    return vectors, first, second


def objective(heads, goal, vectors, truths, keys):
    _, sums = batch_gradient(heads, goal, vectors, truths, keys, 3)
    loss, apart = sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]
    base = (np.exp(-heads.log_vars) * loss + heads.log_vars / 2).sum() if goal.uncertainty else loss.sum()
    return base + goal.alpha * apart.sum()


@pytest.mark.parametrize("goal", GOALS)
def test_gradient_is_the_numeric_one(goal):
    spin = np.random.default_rng(1)
    vectors, first, second = some_rows(25)
    second[:7] = -1  # no truth
    heads = Heads(["a", "b"], [3, 2], spin.normal(size=(5, 5)), np.array([0.3, -0.4]), [np.array([0.5, 1.0, 2.0]), np.ones(2)])
    keys = np.arange(25) - 9
    grads, sums = batch_gradient(heads, goal, vectors, [first, second], keys, 3)
    assert sums[:, 2].tolist() == [25, 18]
    grads[:3] /= 25
    grads[3:] /= 18
    for row in range(5):
        for column in range(5):
            values = []
            for move in (1e-5, -1e-5):
                heads.weight[row, column] += move
                values.append(objective(heads, goal, vectors, [first, second], keys))
                heads.weight[row, column] -= move
            assert grads[row, column] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-7)


def test_terms_agree_with_the_column_expressions(spark):
    from tallyframe.functions import cross_entropy, focal_term, log_softmax, symmetric_kl_term

    z, q, w = [0.3, -1.2, 2.0], [1.0, 0.5, -3.0], [0.5, 2.0, 1.5]
    df = spark.createDataFrame([(z, q, w, 1)], "z array<double>, q array<double>, w array<double>, y int")
    ce = cross_entropy(log_softmax(F.col("z")), F.col("y"), F.col("w"), 0.1)
    row = df.select(focal_term(ce, 3.0).alias("f"), symmetric_kl_term(log_softmax(F.col("z")), log_softmax(F.col("q"))).alias("k")).first()
    assert focal_gradient(np.array([z]), np.array([1]), np.array(w), 3.0, 0.1)[0][0] == pytest.approx(row.f)
    assert divergence_gradient(np.array([z]), np.array([q]))[0][0] == pytest.approx(row.k)


def test_dropped_positions_follow_the_key():
    keys = np.arange(4000)
    once = dropped(np.ones((4000, 8)), keys, 0.25, 5)
    assert (once[::-1] == dropped(np.ones((4000, 8)), keys[::-1], 0.25, 5)).all()
    assert abs((once == 0).mean() - 0.25) < 0.01 and set(np.unique(once)) == {0.0, 1 / 0.75}
    assert (once != dropped(np.ones((4000, 8)), keys, 0.25, 6)).any()
    assert abs(np.corrcoef((once == 0).T)[np.triu_indices(8, 1)]).max() < 0.06


def frame(spark, vectors, first, second):
    rows = [(i, v.tolist(), int(a), int(b) if i % 11 else None) for i, (v, a, b) in enumerate(zip(vectors, first, second))]
    return spark.createDataFrame(rows, "k long, v array<double>, first int, second int")


def test_partitioning_changes_nothing(spark):
    df = frame(spark, *some_rows())
    labels, goal = {"a": "first", "b": "second"}, Objective(2.0, 0.1, 0.5, 0.2)
    done = []
    for parts in (1, 5):
        rows = prepare_rows(df.repartition(parts), "k", "v", labels)
        heads = zero_heads(rows, labels)
        heads.weight[:] = np.linspace(-1, 1, heads.weight.size).reshape(heads.weight.shape)
        done.append(gradient(rows.repartition(parts), heads, goal, 2))
    for one, other in zip(*done):
        assert np.allclose(one, other, rtol=0, atol=1e-12)


def test_training_lowers_the_focal_loss_below_cross_entropy_heads(spark):
    vectors, first, second = some_rows(300)
    spin = np.random.default_rng(2)
    first = np.where(spin.random(300) < 0.3, spin.integers(0, 3, 300), first)  # no head can be sure
    second = np.where(spin.random(300) < 0.3, 1 - second, second)
    df = frame(spark, vectors, first, second)
    labels = {"a": "first", "b": "second"}
    trained = train_heads(df, "k", "v", labels, Objective(5.0), epochs=30, rate=0.2)
    truth = F.when(F.col("task") == "a", F.col("first")).otherwise(F.col("second"))
    loss = {}
    for name, heads in (("joint", trained.heads), ("plain", fit_heads(df, "v", labels, reg_param=0.0))):
        scored = score_heads(df, "v", heads, ["k", "first", "second"]).withColumn("y_true", truth).where("y_true IS NOT NULL")
        loss[name] = {r.task: r.loss for r in focal_loss(scored, 5.0).collect()}
    assert all(loss["joint"][t] < loss["plain"][t] for t in labels)
    assert all(r.log_var < 0 for r in trained.log_vars.collect())


def test_batches_and_two_passes_lower_the_objective(spark):
    df = frame(spark, *some_rows(200))
    trained = train_heads(df, "k", "v", {"a": "first", "b": "second"}, Objective(5.0, 0.05, alpha=0.1, dropout=0.05), epochs=8, batches=2, rate=0.3)
    totals = [r.total_loss for r in trained.history.where("task = 'a'").orderBy("step").collect()]
    assert len(totals) == 16 and totals[-1] < totals[0] - 0.3


def test_training_starts_at_given_heads(spark):
    df = frame(spark, *some_rows(40))
    labels = {"a": "first", "b": "second"}
    plain = fit_heads(df, "v", labels)
    same = train_heads(df, "k", "v", labels, epochs=1, rate=0.0, start=plain).heads
    assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    with pytest.raises(ValueError, match="start from"):
        train_heads(df, "k", "v", {"a": "first"}, start=plain)


def test_unfit_tables_are_refused(spark, table):
    rows = table("k int, v array<double>, y int", (1, [1.0], -1), (2, [1.0], 0))
    with pytest.raises(ValueError, match="class ids"):
        train_heads(rows, "k", "v", {"t": "y"})
    with pytest.raises(ValueError, match="labelled rows"):
        train_heads(rows.limit(0), "k", "v", {"t": "y"})
    with pytest.raises(Exception, match="components"):
        train_heads(table("k int, v array<double>, y int", (1, [1.0], 0), (2, [1.0, 2.0], 1)), "k", "v", {"t": "y"})
