import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import resample
from tallyframe.operators.resample import (
    MEAN_TASK,
    bootstrap_ci,
    bootstrap_draws,
    compare_paired,
    paired_deltas,
    profile_counts,
    replicate_counts,
    replicate_scores,
)

SCHEMA = "run string, task string, row_idx bigint, y_true int, y_pred int"


def macro(true, pred):
    scores = []
    for c in set(true) | {p for p in pred if p is not None}:
        tp = sum(t == c and p == c for t, p in zip(true, pred))
        scores.append(2 * tp / (sum(t == c for t in true) + sum(p == c for p in pred)))
    return sum(scores) / len(scores)


@pytest.fixture(scope="module")
def data():
    generator = random.Random(5)
    out = {}
    for task, k in (("x", 3), ("y", 2)):
        true = [generator.choice(range(k)) for _ in range(120)]
        for run, p in (("c1", 0.9), ("c2", 0.85), ("b1", 0.6)):
            out[task, run] = (true, [
                t if generator.random() < p else generator.choice([*range(k), None]) for t in true
            ])
    return out


@pytest.fixture
def predictions(spark, data):
    rows = [(run, task, i, t, p) for (task, run), (true, pred) in data.items()
            for i, (t, p) in enumerate(zip(true, pred))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def drawn(key, total):
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % total


def brute_hash(data, task, runs, b, seed, joint=False):
    """Positions are rows sorted by block and profile; equal profiles are interchangeable."""
    tasks = ["x", "y"] if joint else [task]

    def code(i):
        return [v for t in tasks for v in
                [data[t, runs[0]][0][i], *(-1 if data[t, r][1][i] is None else data[t, r][1][i] for r in runs)]]

    def place(i):
        text = ",".join(map(str, code(i)))
        return hashlib.md5(text.encode()).hexdigest()[:3], code(i)

    order = sorted(range(120), key=place)
    scope = [] if joint else [task]
    picks = [order[drawn("|".join([str(seed), *scope, str(b), str(k)]), 120)] for k in range(120)]
    return [macro([data[task, r][0][i] for i in picks], [data[task, r][1][i] for i in picks]) for r in runs]


@pytest.mark.parametrize("joint", [False, True])
def test_hash_draws_equal_the_row_by_row_definition(predictions, data, joint):
    runs = ["c1", "c2", "b1"]
    scores = replicate_scores(predictions, ["x", "y"], runs, 6, 11, "hash", joint)
    got = {(r.task, r.b, r.run): r.macro_f1 for r in scores.collect()}
    assert len(got) == 36
    for task in ("x", "y"):
        for b in range(6):
            assert [got[task, b, r] for r in runs] == pytest.approx(brute_hash(data, task, runs, b, 11, joint))


def index_bootstrap(data, task, runs, replicates):
    generator = np.random.default_rng(0)
    means = []
    for _ in range(replicates):
        picks = generator.integers(0, 120, 120)
        means.append(np.mean([
            macro([data[task, r][0][i] for i in picks], [data[task, r][1][i] for i in picks]) for r in runs
        ]))
    return np.array(means)


@pytest.mark.parametrize("per_block", [20_000, 7])
def test_count_draws_have_the_law_of_index_draws(predictions, data, per_block):
    runs = ["c1", "c2"]
    scores = replicate_scores(predictions, ["x"], runs, 1500, 0, "cells", profiles_per_block=per_block)
    got = np.array([r.m for r in scores.groupBy("b").agg(F.avg("macro_f1").alias("m")).collect()])
    reference = index_bootstrap(data, "x", runs, 1500)
    assert len(got) == 1500
    assert got.mean() == pytest.approx(reference.mean(), abs=0.004)
    assert got.std() == pytest.approx(reference.std(), rel=0.12)
    assert np.percentile(got, [2.5, 97.5]) == pytest.approx(np.percentile(reference, [2.5, 97.5]), abs=0.012)


def test_count_draws_do_not_depend_on_partitioning(predictions):
    table = [
        bootstrap_ci(frame, ["x", "y"], ["c1", "c2"], 60).orderBy("task").collect()
        for frame in (predictions, predictions.coalesce(1))
    ]
    assert table[0] == table[1]


def test_identical_runs_are_equivalent(predictions):
    twin = predictions.where("run = 'c1'").withColumn("run", F.lit("twin"))
    deltas = paired_deltas(predictions.unionByName(twin), ["x"], ["c1"], ["twin"], 40)
    row = compare_paired(deltas).first()
    assert (row.delta, row.low, row.high) == (0.0, 0.0, 0.0)
    assert row.p_one_sided == 1.0 and row.p_two_sided == 1.0 and row.equivalent and row.stars == ""


def test_summary_of_given_deltas(table):
    values = [i / 1000 for i in range(-10, 90)]
    row = compare_paired(table("task string, b int, delta double",
                               *(("t", i, v) for i, v in enumerate(values)))).first()
    assert row.delta == pytest.approx(np.mean(values))
    assert (row.low, row.high) == pytest.approx(tuple(np.percentile(values, [2.5, 97.5])))
    assert (row.tost_low, row.tost_high) == pytest.approx(tuple(np.percentile(values, [5, 95])))
    assert row.p_one_sided == pytest.approx(0.11) and row.p_two_sided == pytest.approx(0.22)
    assert row.tost_p == pytest.approx(0.7) and not row.equivalent


def test_mean_row_averages_tasks_on_shared_draws(predictions):
    deltas = paired_deltas(predictions, ["x", "y"], ["c1", "c2"], ["b1"], 30, across_tasks=True)
    rows = {(r.task, r.b): r.delta for r in deltas.collect()}
    assert len(rows) == 90
    for b in range(30):
        assert rows[MEAN_TASK, b] == pytest.approx((rows["x", b] + rows["y", b]) / 2)


def test_task_without_baseline_is_left_out(predictions):
    partial = predictions.where("NOT (run = 'b1' AND task = 'y')")
    deltas = paired_deltas(partial, ["x", "y"], ["c1"], ["b1"], 10)
    assert {r.task for r in deltas.select("task").distinct().collect()} == {"x"}


def test_runs_that_cannot_be_paired_are_refused(predictions):
    with pytest.raises(Exception, match="cannot be paired"):
        profile_counts(predictions.unionByName(predictions.where("row_idx = 3")), ["x"], ["c1", "b1"])
    moved = predictions.withColumn(
        "y_true", F.when(F.expr("run = 'b1' AND row_idx = 3"), (F.col("y_true") + 1) % 3).otherwise(F.col("y_true"))
    )
    with pytest.raises(Exception, match="cannot be paired"):
        profile_counts(moved, ["x"], ["c1", "b1"])
    with pytest.raises(ValueError, match="lacks some examples"):
        profile_counts(predictions.where("NOT (run = 'b1' AND row_idx = 3)"), ["x"], ["c1", "b1"])


@pytest.mark.parametrize("joint", [False, True])
def test_packed_draws_are_the_draws(table, joint):
    sizes = table("scope string, total bigint, slot int", ("a", 70_000, 0), ("b|ü", 131_073, 1), ("c", 3, 2))
    plain = bootstrap_draws(sizes, 2, 7, joint).groupBy("slot", "b").agg(F.array_sort(F.collect_list("at")).alias("at"))
    packed = bootstrap_draws(sizes, 2, 7, joint, packed=True).collect()
    found = {}
    for r in packed:
        found.setdefault((r.slot, r.b), []).append(np.frombuffer(r.places, dtype="<u2").astype("int64") + r.block * 65_536)
    assert {k: np.sort(np.concatenate(v)).tolist() for k, v in found.items()} == {(r.slot, r.b): r["at"] for r in plain.collect()}


def test_keyed_draws_are_the_same_in_any_blocks_and_are_not_shuffled_one_by_one(spark, monkeypatch):
    rows = spark.range(900).select(
        F.explode(F.array(F.lit("r"), F.lit("s"))).alias("run"), F.lit("t").alias("task"), F.col("id").alias("row_idx"),
        (F.col("id") % 3).cast("int").alias("y_true"), F.when(F.col("id") % 7 > 0, F.hash("id", "run") % 2 + 1).alias("y_pred"),
    )
    one = replicate_scores(rows, ["t"], ["r", "s"], 30, 1, "hash").orderBy("b", "run").collect()
    monkeypatch.setattr(resample, "_POSITIONS_PER_BLOCK", 64)
    monkeypatch.setattr(resample, "_REPLICATES_PER_GROUP", 7)
    monkeypatch.setattr(resample, "_DRAWS_PER_PACKED_CHUNK", 100)
    scores = replicate_scores(rows, ["t"], ["r", "s"], 30, 1, "hash")
    assert "at#" not in scores._jdf.queryExecution().executedPlan().toString()
    many = scores.orderBy("b", "run").collect()
    assert [r[:3] for r in many] == [r[:3] for r in one] and [r.macro_f1 for r in many] == pytest.approx([r.macro_f1 for r in one])


def test_blocks_counted_together_give_the_same_counts(spark, monkeypatch):
    rows = spark.range(900).select(
        F.lit("r").alias("run"), F.lit("t").alias("task"), F.col("id").alias("row_idx"),
        (F.col("id") % 30).cast("int").alias("y_true"), F.pmod(F.hash("id"), F.lit(30)).alias("y_pred"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    try:
        found = []
        for together in (1, 32):
            monkeypatch.setattr(resample, "_BLOCKS_PER_BUNDLE", together)
            counts = replicate_counts(rows, ["t"], ["r"], 30, 1, profiles_per_block=4)
            found.append(sorted(counts.collect(), key=str))
            plan = counts._jdf.queryExecution().executedPlan().toString()
            assert "bundle" in plan
        assert found[0] == found[1] and sum(r.n for r in found[0]) == 900 * 30
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
