import math
import statistics

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import interval_text, run_prefix, run_seed, stars
from tallyframe.operators.runs import (
    aggregate_seeds,
    best_epoch,
    compare_settings,
    comparison_text,
    cost_ratios,
    early_stopping,
    epoch_loss,
    leaderboard,
    missing_baselines,
    significance_text,
    stopping_summary,
)

# Published validation means of four training runs (fixed values, cut to four decimals), with
# the number of epochs they ran and their best epoch; patience was 5.
PUBLISHED = {
    "gamma2": (17, 12, [
        0.4714, 0.7657, 0.8364, 0.8772, 0.8852, 0.8962, 0.8996, 0.9036, 0.9020, 0.9036, 0.8987, 0.9085,
        0.9013, 0.8970, 0.9023, 0.8982, 0.9008]),
    "lr3e5": (12, 7, [
        0.5929, 0.8242, 0.8700, 0.8875, 0.8868, 0.8851, 0.8985, 0.8978, 0.8907, 0.8935, 0.8928, 0.8917]),
    "no_uw": (20, 15, [
        0.4894, 0.8059, 0.8637, 0.8737, 0.8755, 0.8868, 0.8976, 0.8991, 0.8966, 0.8996, 0.8971, 0.8957,
        0.8964, 0.8984, 0.9044, 0.8973, 0.8979, 0.8990, 0.8997, 0.9003]),
    "with_rdrop": (14, 9, [
        0.5405, 0.8038, 0.8563, 0.8486, 0.8755, 0.8831, 0.8926, 0.8981, 0.8988, 0.8985, 0.8920, 0.8902,
        0.8968, 0.8925]),
}


def history(table, **curves):
    rows = [(run, e, float(v)) for run, c in curves.items() for e, v in enumerate(c, start=1)]
    return table("run string, epoch int, val_mean_f1 double", *rows)


CURVES = {
    **{name: curve for name, (_, _, curve) in PUBLISHED.items()},
    "rising": [0.1, 0.2, 0.3],
    "flat": [0.5] * 9,
    "zero": [0.0] * 8,
    "late": [0.5, 0.4, 0.4, 0.4, 0.4, 0.6, 0.4],
    "stopped_before_peak": [0.5, 0.4, 0.4, 0.4, 0.4, 0.4, 0.9],
}


# (epoch of the stop, best epoch before it) with patience 5, worked out by hand.
STOPS = {
    "rising": (None, 3),
    "flat": (6, 1),
    "zero": (5, None),
    "late": (None, 6),
    "stopped_before_peak": (6, 1),
}


def test_stops_and_best_epochs(table):
    got = {r.run: (r.stop_epoch, r.best_epoch) for r in stopping_summary(history(table, **CURVES), 5).collect()}
    assert got == STOPS | {name: (stopped, best) for name, (stopped, best, _) in PUBLISHED.items()}


def test_nan_is_no_improvement(table):
    curves = history(table, a=[0.5, float("nan"), 0.6], b=[float("nan")] * 6)
    assert {r.run: r.best_epoch for r in best_epoch(curves).collect()} == {"a": 3}
    got = {r.run: (r.stop_epoch, r.best_epoch) for r in stopping_summary(curves, 5).collect()}
    assert got == {"a": (None, 3), "b": (5, None)}


def test_only_one_stop_mark_and_first_maximum(table):
    steps = early_stopping(history(table, **CURVES), 5)
    assert steps.where("stop").groupBy("run").count().where("count > 1").count() == 0
    best = {r.run: r.best_epoch for r in best_epoch(history(table, **CURVES)).collect()}
    assert best["flat"] == 1 and best["gamma2"] == 12 and "zero" not in best


def metrics(table, *rows):
    return table("prefix string, run string, task string, macro_f1 double", *rows)


def test_seed_aggregate_uses_population_std_and_run_means(table):
    data = metrics(table, ("m", "m1", "a", 0.8), ("m", "m2", "a", 0.9), ("m", "m1", "b", 0.6), ("m", "m3", "b", 0.7))
    got = {r.task: r for r in aggregate_seeds(data).collect()}
    assert got["a"].mean == pytest.approx(0.85) and got["a"]["std"] == pytest.approx(0.05)
    run_means = [0.7, 0.9, 0.7]
    assert got["MEAN_MACRO_F1"].n == 3
    assert got["MEAN_MACRO_F1"]["std"] == pytest.approx(statistics.pstdev(run_means))
    assert (got["b"].min, got["b"].max, got["b"].n) == (0.6, 0.7, 2)


def test_comparison_of_two_settings(table):
    data = metrics(table, ("m", "m1", "a", 0.9437), ("s", "s1", "a", 0.936))
    table_ = compare_settings(aggregate_seeds(data), "m", "s")
    row = table_.where("task = 'a'").first()
    assert row.delta_mean == pytest.approx(0.0077)
    text = comparison_text(table_).where("task = 'a'").first()
    assert (text.first, text.second) == ("0.9437 ± 0.0000", "0.9360 ± 0.0000")


def test_leaderboard_ranks_ties_together(table):
    data = metrics(table, ("p", "x", "a", 0.9), ("p", "y", "a", 0.9), ("p", "z", "a", 0.5))
    got = {r.run: (r.place, r.delta) for r in leaderboard(data).collect()}
    assert got["x"] == got["y"] == (1, 0.0) and got["z"][0] == 3
    to_z = {r.run: r.delta for r in leaderboard(data, reference="z").collect()}
    assert to_z["x"] == pytest.approx(0.4)


def test_missing_baselines_and_epoch_loss(table):
    predictions = table("prefix string, split string, task string", ("s", "test", "a"), ("s", "val", "b"))
    tasks = table("task string", ("a",), ("b",), ("c",))
    assert {r.task for r in missing_baselines(predictions, tasks, "s", "test").collect()} == {"b", "c"}
    log = table("run string, epoch int, loss double", ("r", 1, 2.0), ("r", 1, 4.0), ("r", 2, 1.0))
    assert {r.epoch: r.train_loss for r in epoch_loss(log).collect()} == {1: 3.0, 2: 1.0}


def test_cost_ratios_of_published_figures(table):
    costs = table("setup string, parameters double, disk double, latency double",
                  ("1 multi-task model", 163.0, 652.0, 200.4), ("9 single-task models", 1466.0, 5863.0, 2254.7))
    got = {r.setup: r for r in cost_ratios(costs, "1 multi-task model", ["parameters", "disk", "latency"]).collect()}
    nine = got["9 single-task models"]
    assert [round(nine[f"{c}_ratio"], 2) for c in ("parameters", "disk", "latency")] == [8.99, 8.99, 11.25]
    assert got["1 multi-task model"].disk_ratio == 1.0


def test_texts(table):
    df = table("run string, lo double, hi double, p double", ("exp_1_seed42", -0.0053, 0.024, 0.009),
               ("plain", 0.0, 0.0, 0.03), ("x_seed7_seed8", -0.1, -0.05, 0.2))
    got = df.select(run_prefix(F.col("run")).alias("p"), run_seed(F.col("run")).alias("s"),
                    interval_text(F.col("lo"), F.col("hi")).alias("i"), stars(F.col("p")).alias("m")).collect()
    assert [tuple(r) for r in got] == [
        ("exp_1", 42, "[-0.005, +0.024]", "**"), ("plain", None, "[+0.000, +0.000]", "*"),
        ("x_seed7", 8, "[-0.100, -0.050]", ""),
    ]


# Published equivalence rows (fixed values): task, delta, CI90 low, CI90 high, p, equivalent.
EQUIVALENCE = [
    ("Intent", 0.0082, -0.0035, 0.0218, 0.076, False),
    ("QuestionParticleType", -0.0053, -0.0148, 0.0, 0.0175, True),
    ("Subjectivity", -0.004, -0.0131, 0.0045, 0.005, True),
    ("List", 0.0006, -0.013, 0.0143, 0.0085, True),
    ("PurposeContext", -0.0085, -0.0368, 0.0178, 0.234, False),
]


@pytest.mark.parametrize("row", EQUIVALENCE, ids=lambda r: r[0])
def test_equivalence_flag_is_both_p_and_interval(row):
    _, _, low, high, p, flag = row
    assert (p < 0.05) == flag == (-0.02 < low and high < 0.02)
    assert math.isclose(p * 2000, round(p * 2000), abs_tol=1e-9)


def test_significance_text_layout(table):
    df = table("task string, delta double, low double, high double, p_two_sided double, tost_low double,"
               " tost_high double, tost_p double, equivalent boolean",
               ("Intent", 0.00823, -0.0051, 0.0238, 0.2971, -0.0035, 0.0218, 0.0763, False))
    assert tuple(significance_text(df).first()) == (
        "Intent", 0.0082, "[-0.005, +0.024]", 0.297, "[-0.004, +0.022]", 0.076, False)
